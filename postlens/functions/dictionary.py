"""Dictionary matching of many terms in the JVM: one regex pass per text, or for a short list of substrings a byte search per term.

For the regex pass the terms become one trie-shaped pattern in a lookahead, so every position is
tried once and a position that starts no term fails at its first character.
At a position the longest term that fits is captured; the shorter ones that
also fit there are prefixes of it, and are added from a literal map. Modes:

* ``substring``  - any occurrence;
* ``boundary``   - ``\\b term \\b``;
* ``lookaround`` - ``(?<!\\w) term (?!\\w)``.

Word characters are Python's (letters, numbers and underscore of any script), so
results equal ``re.search`` on the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.text import quote

MODES = ("substring", "boundary", "lookaround")
# Up to so many terms are looked up by ``contains``, some 2.5 ns a byte each; the regex takes some 460 a character.
MAX_CONTAINS = 128
_WORD = r"[\p{L}\p{N}_]"


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _right(term: str, mode: str) -> str:
    """What must follow a term."""
    if mode == "substring":
        return ""
    return rf"(?={_WORD})" if mode == "boundary" and not _is_word(term[-1]) else rf"(?!{_WORD})"


def _left(term: str, mode: str) -> str:
    """What must stand before a term."""
    if mode == "substring":
        return ""
    return rf"(?<={_WORD})" if mode == "boundary" and not _is_word(term[0]) else rf"(?<!{_WORD})"


def _trie_pattern(terms: Sequence[str], mode: str) -> str:
    root: dict = {}
    for term in terms:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = _right(term, mode)

    def build(node: dict) -> str:
        ways = [quote(ch) + build(child) for ch, child in sorted(node.items()) if ch]
        if "" in node:
            ways.append(node[""])  # last: a longer term comes first
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return build(root)


def term_regex(terms: Sequence[str], mode: str) -> str:
    """Pattern whose group 1, at each position, is the longest of the (lower-cased) terms that fits there."""
    if mode not in MODES:
        raise ValueError(f"unknown match mode {mode!r}")
    by_left: dict[str, list[str]] = {}
    for term in sorted(set(terms)):
        by_left.setdefault(_left(term, mode), []).append(term)
    ways = [left + _trie_pattern(own, mode) for left, own in by_left.items()]
    return "(?=(" + "|".join(ways) + "))"


def labels_of(terms: Sequence[tuple[str, str]], mode: str) -> dict[str, list[str]]:
    """For each term, the labels of it and of all terms that fit wherever it does."""
    labels: dict[str, set[str]] = {}
    for term, label in terms:
        labels.setdefault(term, set()).add(label)
    out: dict[str, list[str]] = {}
    for term in labels:
        own = set(labels[term])
        for k in range(1, len(term)):
            short = term[:k]
            if short in labels:
                follows = _right(short, mode)
                if not follows or _is_word(term[k]) == follows.startswith("(?="):
                    own |= labels[short]
        out[term] = sorted(own)
    return out


def _contained(low: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """Sorted distinct labels of the terms that ``low`` contains."""
    by_label = sorted(set(terms), key=lambda p: (p[1], p[0]))
    plain = all(t == label for t, label in by_label)
    known = F.array(*[F.lit(t) if plain else F.struct(F.lit(t).alias("term"), F.lit(label).alias("label")) for t, label in by_label])
    if plain:
        own = lambda x: F.filter(known, lambda t: x.contains(t))
    else:
        own = lambda x: F.transform(F.filter(known, lambda p: x.contains(p["term"])), lambda p: p["label"])
    # as a lambda's variable the text is made once, not once per term
    found = F.flatten(F.transform(F.array(low), own))
    return found if plain else F.array_distinct(found)


def match_terms(text: Column, terms: Sequence[tuple[str, str]], mode: str) -> Column:
    """``array<string>``: sorted distinct labels of the ``(term, label)`` pairs found; empty for null."""
    own = [(t.lower(), label) for t, label in terms if t]
    if mode not in MODES:
        raise ValueError(f"unknown match mode {mode!r}")
    if not own:
        return F.array().cast("array<string>")
    low = F.lower(F.coalesce(text, F.lit("")))
    if mode == "substring" and len(own) <= MAX_CONTAINS:
        return _contained(low, own)
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(term_regex([t for t, _ in own], mode)), F.lit(1)))
    args = [x for t, ls in labels_of(own, mode).items() for x in (F.lit(t), F.array(*[F.lit(label) for label in ls]))]
    by_term = F.create_map(*args)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda t: F.element_at(by_term, t)))))
