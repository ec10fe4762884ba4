"""Names of classes and fields from those of tables and columns."""

from __future__ import annotations

import re

#: Nouns without a plural of their own, and irregular ones. Fixed values.
UNCOUNTABLE = {"children", "data", "information", "series", "news", "metadata", "equipment", "species"}
IRREGULAR = {"person": "people", "man": "men", "woman": "women", "child": "children", "mouse": "mice", "foot": "feet", "tooth": "teeth"}


def words_of(name: str) -> list[str]:
    return [w for part in re.split(r"[^0-9A-Za-z]+", name) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[0-9]+", part)]


def upper_camel(name: str) -> str:
    return "".join(w[:1].upper() + w[1:].lower() for w in words_of(name))


def lower_camel(name: str) -> str:
    found = upper_camel(name)
    return found[:1].lower() + found[1:]


def _last(name: str, change) -> str:
    m = re.search(r"[A-Z]?[a-z]+$", name)
    return name[: m.start()] + change(m.group()) if m else name


def singular(name: str) -> str:
    def one(w: str) -> str:
        low = w.lower()
        if low in UNCOUNTABLE:
            return w
        for s, p in IRREGULAR.items():
            if low == p:
                return w[:1] + s[1:]
        if re.search(r"(?:ss|us|is)$", low):
            return w
        for end, new in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("zes", "z"), ("s", "")):
            if low.endswith(end) and len(low) > len(end):
                return w[: -len(end)] + new
        return w

    return _last(name, one)


def plural(name: str) -> str:
    def many(w: str) -> str:
        low = w.lower()
        if low in UNCOUNTABLE:
            return w
        if low in IRREGULAR:
            return w[:1] + IRREGULAR[low][1:]
        if re.search(r"[^aeiou]y$", low):
            return w[:-1] + "ies"
        return w + ("es" if re.search(r"(?:s|x|z|ch|sh)$", low) else "s")

    return _last(name, many)


def class_name(table: str, prefixes: list[str] | None = None, to_singular: bool = True) -> str:
    """The first prefix that fits is taken off; then singular, then UpperCamel."""
    for p in prefixes or []:
        if table.startswith(p):
            table = table[len(p) :]
            break
    return upper_camel(singular(table) if to_singular else table)


def field_name(column: str, prefixes: list[str] | None = None, camel: bool = True) -> str:
    for p in prefixes or []:
        if column.startswith(p) and len(column) > len(p):
            column = column[len(p) :]
            break
    return lower_camel(column) if camel else column
