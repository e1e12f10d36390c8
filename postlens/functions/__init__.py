"""Reusable column expressions (text, rules, vectors)."""

from postlens.functions.text import (  # noqa: F401
    contains_all,
    contains_any,
    first_contains_label,
    first_regex_label,
    literal_array,
    literal_map,
    matches,
    py_strip,
    quote,
    split_list,
    term_pattern,
    title_case,
)
