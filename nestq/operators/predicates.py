"""``where`` trees as Columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.errors import QueryError
from nestq.functions.values import typed_literal
from nestq.sources.catalog import Entity, Field

NUMERIC = ("is", "eq", "in", "ni", "gt", "ge", "lt", "le", "ne")
KEYS = ("hasKey", "hasKeyAny", "hasKeyAll")
TEXT = ("like", "iLike", "ilike", "regex", "iRegex")
#: Operators of each scalar. A primary key has those of ID and, as a number or text, of its column's type.
OPERATORS = {
    "ID": ("is", "eq", "in", "ni", "gt", "ge", "lt", "le", "ne"),
    "Int": NUMERIC,
    "Float": NUMERIC,
    "DateTime": NUMERIC,
    "Date": NUMERIC,
    "String": NUMERIC + TEXT + KEYS,
    "Boolean": ("is", "eq", "ne", "in", "ni"),
    "Json": ("is", "eq", "ne", "in", "ni") + KEYS,
}


def _listed(value: Any) -> list[Any]:
    return value if isinstance(value, list) else [value]


def _keys(c: Column) -> Column:
    return F.json_object_keys(c.cast("string"))


def compare(c: Column, kind: T.DataType, op: str, value: Any, where: str = "") -> Column:
    """One operator applied to a column; SQL's three-valued logic throughout."""
    lit = lambda v: typed_literal(v, kind, where)
    if op == "is":
        if value in ("NULL", True):
            return c.isNull()
        if value in ("NOT_NULL", False):
            return c.isNotNull()
        raise QueryError(f"operator is of {where}: expected NULL or NOT_NULL, got {value!r}")
    if value is None:
        raise QueryError(f"operator {op} of {where} has no value")
    if op in ("eq", "ne", "gt", "ge", "lt", "le"):
        return {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}[op](c, lit(value))
    if op in ("in", "ni"):
        found = c.isin(*[lit(v) for v in _listed(value)])
        return found if op == "in" else ~found
    if op in TEXT:
        if not isinstance(value, str):
            raise QueryError(f"operator {op} of {where} needs a string")
        text = c.cast("string")
        if op == "like":
            return text.like(value)
        if op in ("iLike", "ilike"):
            return text.ilike(value)
        return text.rlike(("(?i)" if op == "iRegex" else "") + value)
    if op in KEYS:
        names = F.array(*[F.lit(str(v)) for v in _listed(value)]) if _listed(value) else F.array().cast("array<string>")
        held = _keys(c)
        if op == "hasKeyAny":
            found = F.arrays_overlap(held, names)
        else:
            found = F.size(F.array_except(names, held)) == 0
        return F.coalesce(held.isNotNull() & found, F.lit(False))
    raise QueryError(f"unsupported operator {op} of {where}")


#: (relation field, its where tree) -> condition to be met by a semi join
Nested = Callable[[Field, dict[str, Any]], Column]


def condition(e: Entity, df: DataFrame, tree: dict[str, Any], nested: Nested | None = None) -> Column | None:
    """The condition of a where tree, None when it says nothing. Several fields, and several operators of a field, are AND-ed."""
    if not isinstance(tree, dict):
        raise QueryError("where must be an object")
    parts: list[Column] = []
    for name, value in tree.items():
        if name in ("and", "or"):
            items = [] if value is None else _listed(value)
            own = [c for c in (condition(e, df, v, nested) for v in items) if c is not None]
            if not own:
                raise QueryError(f"{name} requires at least one condition")
            parts.append(functools.reduce(operator.and_ if name == "and" else operator.or_, own))
        elif name == "not":
            if value is None:
                raise QueryError("not requires a condition")
            own = [c for c in (condition(e, df, v, nested) for v in _listed(value)) if c is not None]
            if not own:
                raise QueryError("not requires a condition")
            parts.append(~functools.reduce(operator.and_, own))
        else:
            f = e.find(name)
            if f is None:
                raise QueryError(f"unknown field {name} of {e.name}")
            if f.relation:
                if nested is None:
                    raise QueryError(f"a condition on relation {name} is not possible here")
                parts.append(nested(f, value))
                continue
            if not f.column or f.column not in df.columns:
                raise QueryError(f"field {name} of {e.name} has no column to filter on")
            if not isinstance(value, dict):
                raise QueryError(f"field {name} needs an object of operators")
            kind = df.schema[f.column].dataType
            allowed = OPERATORS.get(f.type, OPERATORS["String"])
            for op, v in value.items():
                if op not in allowed:
                    raise QueryError(f"unsupported operator {op} of {name}")
                parts.append(compare(F.col(f"`{f.column}`"), kind, op, v, name))
    return functools.reduce(operator.and_, parts) if parts else None
