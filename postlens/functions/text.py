"""Column expressions for text: all JVM-side, no Python UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are "word" characters for Python's Unicode \w.
WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"

_REGEX_META = set("\\.^$|?*+()[]{}")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Whitespace stripped by ``py_strip``: what Python's ``str.isspace`` holds (fixed values).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")

# Java's \s, \w, \d and \b are ASCII without this flag; Python's are not.
UNICODE = "(?U)"


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()`` as a cheap ``btrim`` (no regex)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def title_case(c: str | Column) -> Column:
    """Python ``str.title()``: upper-case the first letter of every letter run.

    ``initcap`` only capitalises after spaces (``c++/java`` stays ``C++/java``);
    Python capitalises after any non-letter. So a space is inserted after every
    non-letter, ``initcap`` runs, and the inserted spaces are removed again --
    three codegen'd string functions, no per-element lambda.
    """
    marked = F.regexp_replace(F.lower(col(c)), r"([^\p{L}])", "$1 ")
    return F.regexp_replace(F.initcap(marked), r"([^\p{L}]) ", "$1")


def quote(term: str) -> str:
    """Escape a literal for use inside a Java (and RE2) regular expression."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in term)


def term_pattern(term: str, mode: str) -> str:
    """Pattern that finds ``term`` in lower-cased text.

    * ``boundary``   – ``\\b term \\b`` with Unicode word characters (``c++`` needs a
      word character after it, as in Python).
    * ``lookaround`` – not preceded nor followed by a word character.
    """
    q = quote(term)
    if mode == "boundary":
        return r"(?U)\b" + q + r"\b"
    if mode == "lookaround":
        return r"(?<!" + WORD_CLASS + ")" + q + r"(?!" + WORD_CLASS + ")"
    raise ValueError(f"unknown match mode {mode!r}")


def matches(text: Column, term: str, mode: str) -> Column:
    """Boolean: ``term`` occurs in ``text`` (already lower-cased) under ``mode``."""
    if mode == "substring":
        return F.instr(text, term) > 0
    return text.rlike(term_pattern(term, mode))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """Any needle is a substring (``contains`` is ~3x cheaper than ``instr > 0``)."""
    needles = list(needles)
    if not needles:
        return F.lit(False)
    out = text.contains(needles[0])
    for n in needles[1:]:
        out = out | text.contains(n)
    return out


def contains_all(text: Column, needles: Iterable[str]) -> Column:
    needles = list(needles)
    out = text.contains(needles[0])
    for n in needles[1:]:
        out = out & text.contains(n)
    return out


_QUANT = set("?*{")
_META = set("\\.^$|?*+()[]{}")


_CLASS = re.compile(r"\[(?:\\.|[^\[\]\\&])+\]")


def _top_level_alternatives(pattern: str, classes: bool = False) -> list[str] | None:
    parts, depth, cur, i = [], 0, [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            cur.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[":
            own = _CLASS.match(pattern, i) if classes else None
            if own is None:
                return None  # character classes: no prefilter
            cur.append(own[0])
            i = own.end()
            continue
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "|" and depth == 0:
            parts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
        i += 1
    parts.append("".join(cur))
    return parts


def required_literal(alternative: str) -> str:
    """Longest run of plain characters outside groups that every match contains.

    A character followed by ``?``, ``*`` or ``{`` is optional and ends the run;
    escapes and groups end it too. Returns '' when nothing is certain.
    """
    best, cur, depth, i = "", "", 0, 0
    while i < len(alternative):
        ch = alternative[i]
        nxt = alternative[i + 1] if i + 1 < len(alternative) else ""
        if ch == "\\":
            best, cur = max(best, cur, key=len), ""
            i += 2
            continue
        if ch in "()":
            depth += 1 if ch == "(" else -1
            best, cur = max(best, cur, key=len), ""
        elif depth > 0 or ch in _META or nxt in _QUANT:
            best, cur = max(best, cur, key=len), ""
        else:
            cur += ch
            if nxt == "+":
                best, cur = max(best, cur, key=len), ""
        i += 1
    return max(best, cur, key=len)


def regex_prefilter(text: Column, pattern: str) -> Column | None:
    """A cheap necessary condition for ``text RLIKE pattern`` (or None)."""
    if pattern.startswith("(?"):
        return None
    alts = _top_level_alternatives(pattern)
    if not alts:
        return None
    lits = [required_literal(a) for a in alts]
    if any(len(x) < 2 for x in lits):
        return None
    return contains_any(text, lits)


# Inline flags, lookarounds, back references and quoting: such patterns are taken as they are.
_SPECIAL = re.compile(r"\(\?[^:]|\\[1-9kQ]")
_FIRST = re.compile(r"(\[[^\[\]\\^&]+\]|\\[$.+*?()\[\]{}|^\\]|[^\\.^$|?*+()\[\]{}])(?![?*{])")


def first_characters(pattern: str) -> str | None:
    """What every match begins with, as the inside of a character class; None where that is not plain to see."""
    out = ""
    for alt in ([] if _SPECIAL.search(pattern) else _top_level_alternatives(pattern, classes=True)) or [""]:
        alt = alt.removeprefix(r"\b")
        if alt.startswith("(?:"):
            depth, end, i = 0, None, 0
            while i < len(alt) and end is None:
                if alt[i] == "[":
                    i = _CLASS.match(alt, i).end()
                    continue
                depth += {"(": 1, ")": -1}.get(alt[i], 0)
                end = i if depth == 0 else None
                i += 2 if alt[i] == "\\" else 1
            own = None if end is None or alt[end + 1:end + 2] in _QUANT else first_characters(alt[3:end])
        else:
            first = _FIRST.match(alt)
            own = None if first is None else first[1][1:-1] if first[1].startswith("[") else first[1] if first[1] not in "-&" else "\\" + first[1]
        if own is None:
            return None
        out += own
    return out


def anchored_pattern(pattern: str) -> str:
    """The same pattern, tried only where one of its first characters stands (one class test elsewhere, before any ``\\b``)."""
    first = first_characters(pattern)
    return pattern if first is None else f"(?=[{first}])(?:{pattern})"


def guarded_rlike(text: Column, pattern: str) -> Column:
    """``text RLIKE pattern``, skipped when a required literal is absent.

    Without one for the whole pattern, each alternative is asked for by itself: a plain one by ``contains``,
    the others behind their own literal or first characters.
    """
    pre = regex_prefilter(text, pattern)
    if pre is not None:
        return pre & text.rlike(UNICODE + pattern)
    alts = None if _SPECIAL.search(pattern) else _top_level_alternatives(pattern, classes=True)
    if alts is None:
        return text.rlike(UNICODE + pattern)

    def one(alt: str) -> Column:
        if alt and not _META & set(alt):
            return text.contains(alt)
        own = regex_prefilter(text, alt)
        return text.rlike(UNICODE + anchored_pattern(alt)) if own is None else own & text.rlike(UNICODE + alt)

    out = one(alts[0])
    for alt in alts[1:]:
        out = out | one(alt)
    return out


def first_regex_label(text: Column, rules: Sequence[tuple[str, str]], default: Column | None) -> Column:
    """CASE WHEN text RLIKE p1 THEN l1 ... ELSE default (first match wins).

    Each regex is guarded by a literal prefilter (``guarded_rlike``).
    """
    expr = None
    for pattern, label in rules:
        cond = guarded_rlike(text, pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return default if default is not None else F.lit(None).cast("string")
    return expr.otherwise(default) if default is not None else expr


def first_contains_label(text: Column, rules: Sequence[tuple[Sequence[str], str]],
                         default: Column | None, all_of: bool = False) -> Column:
    """CASE WHEN any/all needles contained THEN label ... (first match wins)."""
    expr = None
    for needles, label in rules:
        cond = contains_all(text, needles) if all_of else contains_any(text, needles)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return default if default is not None else F.lit(None).cast("string")
    return expr.otherwise(default) if default is not None else expr


def literal_map(pairs: Sequence[tuple[str, object]]) -> Column:
    """Literal ``map`` column from ordered pairs (later duplicates are dropped)."""
    seen: dict[str, object] = {}
    for k, v in pairs:
        seen.setdefault(k, v)
    if not seen:
        return F.create_map().cast("map<string,string>")
    args = []
    for k, v in seen.items():
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def literal_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def split_list(c: str | Column, sep: str = ",") -> Column:
    """Comma list -> trimmed, lower-cased, non-blank items (duplicates kept)."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), sep), lambda s: F.lower(py_strip(s)))
    return F.filter(parts, lambda s: F.length(s) > 0)
