"""DuckDB SQL fragments for the oracle queries.

The oracle is an independent formulation of each operator in plain SQL; these
helpers only turn the shared parameter tables (rules, vocabularies) into SQL
literals and CASE chains.
"""

from __future__ import annotations

from collections.abc import Sequence

from postlens import vocab as V
from postlens.sources.fixtures import duckdb_view


def s(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'"


def str_list(values: Sequence[str]) -> str:
    if not values:
        return "[]::VARCHAR[]"
    return "[" + ", ".join(s(v) for v in values) + "]"


def strip(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def title_case(expr: str) -> str:
    return (f"coalesce(list_aggregate(list_transform(regexp_extract_all(lower({expr}), '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            f"lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), 'string_agg', ''), '')")


def regex_chain(expr: str, rules: Sequence[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({expr}, {s(p)}) THEN {s(label)}" for p, label in rules)
    return f"CASE {whens} ELSE {default} END"


def any_contains(expr: str, needles: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {s(n)})" for n in needles) + ")"


def all_contains(expr: str, needles: Sequence[str]) -> str:
    return "(" + " AND ".join(f"contains({expr}, {s(n)})" for n in needles) + ")"


def contains_chain(expr: str, rules, default: str, all_of: bool = False) -> str:
    f = all_contains if all_of else any_contains
    whens = " ".join(f"WHEN {f(expr, needles)} THEN {s(label)}" for needles, label in rules)
    return f"CASE {whens} ELSE {default} END"


def lookup(expr: str, pairs: Sequence[tuple[str, object]], default: str) -> str:
    seen: dict[str, object] = {}
    for k, v in pairs:
        seen.setdefault(k, v)
    whens = " ".join(f"WHEN {s(k)} THEN {s(v) if isinstance(v, str) else f"CAST({float(v)!r} AS DOUBLE)"}" for k, v in seen.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def normalize_skill(expr: str) -> str:
    key = f"lower({strip(expr)})"
    return lookup(key, V.VOCAB.normalization, key)


def parse_skills(expr: str) -> str:
    j = f"replace({expr}, '''', '\"')"
    items = (f"CASE WHEN {expr} IS NULL THEN []::VARCHAR[] "
             f"WHEN json_valid({j}) AND json_type({j}) = 'ARRAY' THEN from_json({j}, '[\"VARCHAR\"]') "
             f"ELSE list_transform(string_split({expr}, ','), lambda x: {strip('x')}) END")
    return f"list_filter(list_transform({items}, lambda x: {normalize_skill('x')}), lambda x: x IS NOT NULL AND length(x) > 0)"


def split_list(expr: str) -> str:
    return (f"list_filter(list_transform(string_split(coalesce({expr}, ''), ','), lambda x: lower({strip('x')})), "
            f"lambda x: length(x) > 0)")


def title_std(expr: str = "title") -> str:
    low = f"lower({strip(expr)})"
    return f"CASE WHEN {expr} IS NULL THEN 'Unknown' ELSE {regex_chain(low, V.TITLE_RULES, title_case(strip(expr)))} END"


def location_cols(expr: str = "location") -> tuple[str, str]:
    st = strip(expr)
    parts = f"string_split({st}, ',')"
    city_raw = strip(f"{parts}[1]")
    second = strip(f"{parts}[2]")
    city = lookup(f"lower({city_raw})", V.CITY_ALIASES, title_case(city_raw))
    state = f"CASE WHEN len({parts}) >= 2 THEN substr(upper({second}), 1, 2) ELSE 'Unknown' END"
    remote = f"contains(lower({st}), 'remote')"
    city_out = f"CASE WHEN {expr} IS NULL THEN 'Unknown' WHEN {remote} THEN 'Remote' ELSE {city} END"
    state_out = f"CASE WHEN {expr} IS NULL THEN 'Unknown' WHEN {remote} THEN 'USA' ELSE {state} END"
    return city_out, state_out


POSTING_COLUMNS = ["job_id", "title", "company", "company_size", "location", "description", "skills",
                   "salary_min", "salary_max", "job_type", "posted_at", "source"]


def cleaned_ctes(dedup: bool = True) -> str:
    """CTEs ``postings`` -> ``cleaned`` (B9) for DuckDB."""
    city, state = location_cols("location")
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in POSTING_COLUMNS)
    role = contains_chain("lower(title_standardized)", V.ROLE_RULES, s(V.ROLE_DEFAULT))
    dd = (f"deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "
          f"title_standardized, company, city_standardized ORDER BY {order}) AS rn FROM filled) WHERE rn = 1),\n"
          if dedup else "deduped AS (SELECT * FROM filled),\n")
    return (
        f"postings AS (\n{duckdb_view('postings')}\n),\n"
        f"stage1 AS (SELECT *, {title_std('title')} AS title_standardized, "
        f"{parse_skills('skills')} AS skills_normalized, {city} AS city_standardized, "
        f"{state} AS state_standardized FROM postings),\n"
        f"filled AS (SELECT * REPLACE (coalesce(company, 'Unknown Company') AS company) FROM stage1),\n"
        + dd +
        f"cleaned AS (SELECT *, {role} AS role_category, CAST(len(skills_normalized) AS BIGINT) AS skill_count "
        f"FROM deduped)\n"
    )


def with_cleaned(*extra: str, dedup: bool = True) -> str:
    body = cleaned_ctes(dedup)
    if extra:
        body = body.rstrip("\n") + ",\n" + ",\n".join(extra) + "\n"
    return "WITH " + body


def quote_re(term: str) -> str:
    return "".join("\\" + ch if ch in set("\\.^$|?*+()[]{}") else ch for ch in term)


def term_cond(low: str, term: str, mode: str) -> str:
    if mode == "substring":
        return f"contains({low}, {s(term)})"
    if mode == "boundary":
        return f"regexp_matches({low}, {s(chr(92) + 'b' + quote_re(term) + chr(92) + 'b')})"
    nw = "[^\\p{L}\\p{N}_]"
    return f"regexp_matches({low}, {s('(^|' + nw + ')' + quote_re(term) + '(' + nw + '|$)')})"


def dictionary_terms(low: str, terms, mode: str) -> str:
    cases = ", ".join(f"CASE WHEN {term_cond(low, t, mode)} THEN {s(label)} END" for t, label in terms)
    return f"list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL)))"


def first_regex(low: str, rules, default: str = "NULL") -> str:
    return regex_chain(low, rules, default)
