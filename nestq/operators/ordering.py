"""Sort, limit, offset, keyset cursors and distinct."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestq.errors import QueryError
from nestq.functions.values import decode_cursor, typed_literal
from nestq.sources.catalog import Entity

#: direction -> (descending, nulls first). A plain direction places nulls as PostgreSQL does: last when ascending, first when descending.
DIRECTIONS = {
    "ASC": (False, False),
    "DESC": (True, True),
    "ASC_NULLS_FIRST": (False, True),
    "ASC_NULLS_LAST": (False, False),
    "DESC_NULLS_FIRST": (True, True),
    "DESC_NULLS_LAST": (True, False),
}


@dataclass
class Key:
    column: str
    descending: bool = False
    nulls_first: bool = False

    def order(self, reverse: bool = False) -> Column:
        c = F.col(f"`{self.column}`")
        down, first = self.descending != reverse, self.nulls_first != reverse
        if down:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


@dataclass
class Paging:
    keys: list[Key] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    after: dict[str, Any] | None = None
    before: dict[str, Any] | None = None
    backward: bool = False  # the last rows are wanted
    distinct: list[str] = field(default_factory=list)


def sort_keys(e: Entity, given: Any, legacy: bool = False) -> list[Key]:
    """Keys of ``sort`` (an object or a list of them, in the order written) or, with ``legacy``, of ``orderBy``."""
    out: list[Key] = []
    for item in given if isinstance(given, list) else [given] if given is not None else []:
        if not isinstance(item, dict):
            raise QueryError("sort must be an object or a list of objects")
        for name, direction in item.items():
            f = e.find(name)
            if f is None or f.relation or not f.column:
                raise QueryError(f"{e.name} cannot be sorted by {name}")
            if not isinstance(direction, str) or direction not in DIRECTIONS or (legacy and direction not in ("ASC", "DESC")):
                raise QueryError(f"unknown sort direction {direction!r} of {name}")
            out.append(Key(f.column, *DIRECTIONS[direction]))
    return out


def _number(args: dict[str, Any], name: str) -> int | None:
    value = args.get(name)
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int):
        raise QueryError(f"{name} must be an integer")
    if value < 0:
        raise QueryError(f"{name} must not be negative")
    return value


def paging(e: Entity, args: dict[str, Any], default_limit: int | None) -> Paging:
    """What the paging arguments ask for. limit 0 is no limit; a cursor excludes an offset; sort goes before orderBy."""
    keys = sort_keys(e, args.get("sort")) or sort_keys(e, args.get("orderBy"), legacy=True)
    limit, offset, first, last = (_number(args, n) for n in ("limit", "offset", "first", "last"))
    cursor = args.get("after") is not None or args.get("before") is not None
    if cursor and offset:
        raise QueryError("offset cannot be combined with a cursor")
    if first is not None and last is not None:
        raise QueryError("first cannot be combined with last")
    names = [f.name for f in e.columns if f.column in e.key_columns]
    if (cursor or first is not None or last is not None) and not names:
        raise QueryError(f"{e.name} has no primary key to page by")
    p = Paging(keys, offset=offset or 0, backward=last is not None)
    p.after, p.before = (decode_cursor(args[n], names) if args.get(n) is not None else None for n in ("after", "before"))
    if cursor or first is not None or last is not None:
        p.keys = [Key(c) for c in e.key_columns]
    p.limit = first if first is not None else last if last is not None else limit
    if p.limit is None:
        p.limit = default_limit
    if p.limit == 0 and first is None and last is None:
        p.limit = None
    for name in args.get("distinct") or []:
        f = e.find(name)
        if f is None or not f.column:
            raise QueryError(f"unknown field {name} in distinct")
        p.distinct.append(f.column)
    if p.limit is not None or p.offset or p.distinct:  # a total order makes pages stable
        p.keys += [Key(c) for c in e.key_columns if c not in [k.column for k in p.keys]]
    return p


def keyset(e: Entity, df: DataFrame, p: Paging) -> DataFrame:
    """Rows strictly after and before the cursors, by primary key."""
    for given, up in ((p.after, True), (p.before, False)):
        if given is None:
            continue
        pairs = []
        for f in e.columns:
            if f.column in e.key_columns:
                pairs.append((F.col(f"`{f.column}`"), typed_literal(given[f.name], df.schema[f.column].dataType, f.name)))
        found = F.lit(False)
        for c, v in reversed(pairs):
            found = ((c > v) if up else (c < v)) | ((c == v) & found)
        df = df.where(found)
    return df


def paged(e: Entity, df: DataFrame, p: Paging, extra: int = 0) -> DataFrame:
    """The page, in order: keyset, sort, offset and limit, then DISTINCT ON. ``extra`` rows beyond the limit tell whether there is more."""
    df = keyset(e, df, p)
    if p.keys:
        df = df.orderBy(*[k.order(p.backward) for k in p.keys])
    if p.offset:
        df = df.offset(p.offset)
    if p.limit is not None:
        df = df.limit(p.limit + extra)
    if p.distinct:
        df = distinct_on(df, p.distinct, p.keys)
    return df


def distinct_on(df: DataFrame, columns: list[str], keys: list[Key]) -> DataFrame:
    """The first row, by the keys, of each combination of the columns."""
    order = [k.order() for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in columns]).orderBy(*order)
    return df.withColumn("__dn", F.row_number().over(w)).where("__dn = 1").drop("__dn")


def paged_per_parent(df: DataFrame, p: Paging, parent: str, order_columns: list[str]) -> DataFrame:
    """The page of each parent, numbered from 1 in ``__rn``; the filter on the number becomes a group limit in the window."""
    order = [k.order(p.backward) for k in p.keys] + [F.col(f"`{c}`").asc_nulls_last() for c in order_columns if c not in [k.column for k in p.keys]]
    w = Window.partitionBy(parent).orderBy(*(order or [F.lit(0)]))
    df = df.withColumn("__rn", F.row_number().over(w))
    if p.limit is not None:
        df = df.where(F.col("__rn") <= p.offset + p.limit)
    if p.offset:
        df = df.where(F.col("__rn") > p.offset)
    if p.distinct:
        w = Window.partitionBy(parent, *[F.col(f"`{c}`") for c in p.distinct]).orderBy("__rn")
        df = df.withColumn("__dn", F.row_number().over(w)).where("__dn = 1").drop("__dn")
    return df.withColumn("__rn", -F.col("__rn")) if p.backward else df
