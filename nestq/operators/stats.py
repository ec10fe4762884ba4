"""Statistics over columns, and groups."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.errors import QueryError
from nestq.operators.ordering import DIRECTIONS
from nestq.operators.predicates import compare
from nestq.plans.lang import Field as Selected
from nestq.sources.catalog import Entity, Field

NUMBER = ("sum", "avg", "min", "max", "count", "countDistinct")
BY_KIND = {"NumberStats": NUMBER, "StringStats": NUMBER[2:], "DateTimeStats": NUMBER[2:]}
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def stats_kind(f: Field, kind: T.DataType | None = None) -> str | None:
    """Which statistics a field has; a key that is text has those of text."""
    if f.relation or not f.column:
        return None
    if f.type in ("Int", "Float"):
        return "NumberStats"
    if f.type == "ID":
        return "StringStats" if kind is not None and not isinstance(kind, T.NumericType) else "NumberStats"
    return {"String": "StringStats", "DateTime": "DateTimeStats", "Date": "DateTimeStats"}.get(f.type)


def aggregate(name: str, c: Column, kind: str) -> Column:
    if name == "count":
        return F.count(c)
    if name == "countDistinct":
        return F.countDistinct(c)
    if name not in BY_KIND[kind]:
        raise QueryError(f"{kind} has no {name}")
    if name in ("sum", "avg"):
        return (F.sum(c) if name == "sum" else F.avg(c)).cast("double")
    found = F.min(c) if name == "min" else F.max(c)
    return found.cast("double") if kind == "NumberStats" else found


def selected_aggregates(e: Entity, df: DataFrame, fields: list[Selected], inner: Callable[[Selected], list[Selected]], filtered: Callable[[dict], Column]) -> list[tuple[str, Column, str]]:
    """(path, aggregate, response key of the field or "") of everything selected; an argument ``where`` restricts what one aggregate sees."""
    out = []
    for s in fields:
        keep = filtered(s.args["where"]) if s.args.get("where") else None
        seen = lambda c, keep=keep: c if keep is None else F.when(keep, c)
        if s.name == "count":
            out.append((s.key, F.count(seen(F.lit(1))), ""))
            continue
        f = e.find(s.name)
        kind = stats_kind(f, df.schema[f.column].dataType) if f and f.column in df.columns else None
        if kind is None:
            raise QueryError(f"{e.name} has no statistics of {s.name}")
        for a in inner(s):
            out.append((a.key, aggregate(a.name, seen(F.col(f"`{f.column}`")), kind), s.key))
    return out


def shaped(aggregates: list[tuple[str, Column, str]], names: list[str]) -> list[Column]:
    """Aggregates as columns: plain ones by their key, those of a field as one struct."""
    out, done = [], set()
    for (key, _, owner), name in zip(aggregates, names, strict=True):
        if not owner:
            out.append(F.col(name).alias(key))
        elif owner not in done:
            done.add(owner)
            parts = [F.col(n).alias(k) for (k, _, o), n in zip(aggregates, names, strict=True) if o == owner]
            out.append(F.struct(*parts).alias(owner))
    return out


def whole(df: DataFrame, aggregates: list[tuple[str, Column, str]]) -> DataFrame:
    """One row."""
    names = [f"__a{i}" for i in range(len(aggregates))]
    return df.agg(*[a.alias(n) for (_, a, _), n in zip(aggregates, names, strict=True)]).select(*shaped(aggregates, names))


def group_key(e: Entity, spec: str) -> tuple[str, Column]:
    """``field``, ``field:month`` (truncated to a unit) or ``field:10 minutes`` (start of the window it falls into)."""
    name, _, bucket = spec.partition(":")
    f = e.find(name)
    if f is None or not f.column:
        raise QueryError(f"unknown field {name} in groupBy")
    c = F.col(f"`{f.column}`")
    if not bucket:
        return f.name, c
    if bucket in UNITS:
        return f.name, F.date_trunc(bucket, c)
    if re.fullmatch(r"[0-9]+ (?:second|minute|hour|day|week)s?", bucket):
        return f.name, F.window(c, bucket)["start"]
    raise QueryError(f"unknown time bucket {bucket!r}")


def groups(e: Entity, df: DataFrame, by: dict[str, Any], aggregates: list[tuple[str, Column, str]]) -> DataFrame:
    """A row per group: ``key`` (a struct of the group's fields) and the aggregates.

    ``having`` is an object {count or field.aggregate or field: {op: value}}, ``sort`` {the same: direction}; groups are in the order of
    ``sort``, ties by key; ``limit`` comes last.
    """
    specs = by.get("fields") or []
    if not specs or not isinstance(specs, list):
        raise QueryError("groupBy requires at least one field")
    keys = [group_key(e, s) for s in specs]
    extra: list[tuple[str, Column]] = []

    def name_of(path: str) -> str:
        """The column of something that having or sort names, aggregated as well when it was not selected."""
        for k, (n, _) in enumerate(keys):
            if n == path:
                return f"__k{k}"
        owner, _, what = path.rpartition(".")
        if path == "count":
            found = F.count(F.lit(1))
        else:
            f = e.find(owner) if owner else None
            kind = stats_kind(f, df.schema[f.column].dataType) if f else None
            if kind is None:
                raise QueryError(f"unknown aggregate {path}")
            found = aggregate(what, F.col(f"`{f.column}`"), kind)
        extra.append((f"__x{len(extra)}", found))
        return extra[-1][0]

    sort_items = by.get("sort") or {}
    merged: dict[str, Any] = {}
    for item in sort_items if isinstance(sort_items, list) else [sort_items]:
        merged |= item
    order = []
    for path, direction in merged.items():
        if direction not in DIRECTIONS:
            raise QueryError(f"unknown sort direction {direction!r} of {path}")
        order.append((name_of(path), *DIRECTIONS[direction]))
    having = [(name_of(path), path, ops) for path, ops in _flat(by.get("having") or {}).items()]

    names = [f"__a{i}" for i in range(len(aggregates))]
    made = df.groupBy(*[c.alias(f"__k{i}") for i, (_, c) in enumerate(keys)])
    calls = [a.alias(n) for (_, a, _), n in zip(aggregates, names, strict=True)] + [a.alias(n) for n, a in extra]
    out = made.agg(*calls) if calls else made.agg(F.count(F.lit(1)).alias("__n"))
    for name, path, ops in having:
        for op, v in ops.items():
            out = out.where(compare(F.col(name), out.schema[name].dataType, op, v, path))
    limit = by.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise QueryError("limit must be a non-negative integer")
    if order or limit:
        sorts = []
        for name, down, first in order:
            c = F.col(name)
            sorts.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        out = out.orderBy(*sorts, *[F.col(f"__k{i}").asc_nulls_last() for i in range(len(keys))])
    if limit:
        out = out.limit(limit)
    key = F.struct(*[F.col(f"__k{i}").alias(n) for i, (n, _) in enumerate(keys)]).alias("key")
    return out.select(key, *shaped(aggregates, names))


def _flat(tree: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """{"total": {"sum": {"gt": 1}}} as {"total.sum": {"gt": 1}}."""
    out: dict[str, dict[str, Any]] = {}
    for name, value in tree.items():
        if not isinstance(value, dict):
            out[name] = {"eq": value}
            continue
        for op, v in value.items():
            if op in NUMBER and isinstance(v, dict):
                out[f"{name}.{op}"] = v
            else:
                out.setdefault(name, {})[op] = v
    return out
