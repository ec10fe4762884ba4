"""Mutations on immutable frames: each gives an entity a new image, and returns the rows it touched."""

from __future__ import annotations

import datetime as dt
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.errors import QueryError
from nestq.functions.values import parse_datetime, typed_literal
from nestq.sources.catalog import MANY_TO_MANY, MANY_TO_ONE, ONE_TO_MANY, Entity, Field

if TYPE_CHECKING:
    from nestq.plans.planner import Planner

#: Columns that mutations stamp when an entity has them. Fixed names.
CREATED, UPDATED, DELETED = "created_at", "updated_at", "deleted_at"
CREATED_BY, UPDATED_BY, DELETED_BY = "created_by", "updated_by", "deleted_by"


def _python(value: Any, kind: T.DataType, name: str) -> Any:
    """A value as Spark wants it in a row of that type."""
    typed_literal(value, kind, name)
    if value is None:
        return None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return parse_datetime(value)
    if isinstance(kind, T.DateType):
        return parse_datetime(value).date()
    if isinstance(kind, T.IntegralType):
        return int(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(kind, T.DecimalType):
        from decimal import Decimal

        return Decimal(str(value))
    if isinstance(kind, T.StringType):
        import json

        return json.dumps(value) if isinstance(value, (dict, list)) else str(value)
    return value


class Mutations:
    def __init__(self, planner: Planner):
        self.planner, self.engine = planner, planner.engine
        #: One time for all stamps of a mutation, taken here: an image that is read again later still says the same.
        self.moment = dt.datetime.now(dt.timezone.utc)

    def _now(self, kind: T.DataType) -> Column:
        return F.lit(self.moment).cast(kind)

    def _stamps(self, df: DataFrame, at: str, by: str) -> dict[str, Column]:
        """What a time column and a user column are set to, as far as there are such and a user is known."""
        out = {at: self._now(df.schema[at].dataType)} if at in df.columns else {}
        if by in df.columns and self.engine.user is not None:
            out[by] = typed_literal(self.engine.user, df.schema[by].dataType, by)
        return out

    # -- input

    def _split(self, e: Entity, given: dict[str, Any]) -> tuple[dict[str, Any], list[tuple[Field, Any]]]:
        """({column: value}, [(relation, what was said of it)])."""
        if not isinstance(given, dict):
            raise QueryError(f"input of {e.name} must be an object")
        values, related = {}, []
        for name, v in given.items():
            f = e.find(name)
            if f is None:
                raise QueryError(f"unknown field {name} of {e.name}")
            if f.relation:
                related.append((f, v))
            elif not f.column:
                raise QueryError(f"field {name} of {e.name} is virtual")
            else:
                values[f.column] = v
        return values, related

    def _frame(self, rows: list[dict[str, Any]], schema: T.StructType, e: Entity) -> DataFrame:
        typed = [tuple(_python(r.get(f.name), f.dataType, f.name) for f in schema) for r in rows]
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        return self.engine.spark.createDataFrame(typed, loose)

    def _next_key(self, e: Entity, df: DataFrame) -> int:
        return (df.agg(F.max(F.col(f"`{e.key_columns[0]}`"))).first()[0] or 0) + 1

    # -- create

    def create(self, e: Entity, given: Any, strict: bool = True) -> DataFrame:
        """New rows of one input or a list of them. Inputs of to-many relations become rows too, with the parent's key.

        A missing single numeric key is the next one; creation and update times are stamped. ``strict``: required fields must be there.
        """
        df = self.engine.rows(e, unscoped=True)
        inputs = given if isinstance(given, list) else [given]
        rows, later = [], []
        key = e.key_columns[0] if len(e.key_columns) == 1 else None
        following = None
        for one in inputs:
            values, related = self._split(e, one)
            if key and values.get(key) is None and isinstance(df.schema[key].dataType, T.IntegralType):
                following = self._next_key(e, df) if following is None else following + 1
                values[key] = following
            for stamp in (CREATED, UPDATED):
                if stamp in df.columns and values.get(stamp) is None and stamp == CREATED:
                    values[stamp] = self.moment.replace(tzinfo=None)
            for by in (CREATED_BY, UPDATED_BY):
                if by in df.columns and values.get(by) is None and self.engine.user is not None:
                    values[by] = self.engine.user
            for f, v in related:
                if f.relation.kind == MANY_TO_ONE and isinstance(v, dict) and "connect" in v:
                    values[f.relation.source_column] = v["connect"][0] if isinstance(v["connect"], list) else v["connect"]
            if strict:
                for f in e.columns:
                    if f.column in df.columns and not f.nullable and values.get(f.column) is None:
                        raise QueryError(f"field {f.name} of {e.name} is required")
            rows.append(values)
            later += [(values, f, v) for f, v in related if f.relation.kind != MANY_TO_ONE]
        if not rows:
            raise QueryError(f"nothing to create in {e.name}")
        if e.key_columns:
            self._refuse_known(e, df, rows)
        fresh = self._frame(rows, df.schema, e)
        self.engine.replace(e, df.unionByName(fresh))
        for values, f, v in later:
            own = values.get(f.relation.source_column)
            if isinstance(v, dict) and ("connect" in v or "disconnect" in v):
                self.relate(e, f, [own], v)
            else:
                target = self.engine.catalog.entity(f.relation.target)
                items = v if isinstance(v, list) else [v]
                if f.relation.kind == ONE_TO_MANY:
                    back = next(t for t in target.columns if t.column == f.relation.target_column)
                    self.create(target, [{**i, back.name: own} for i in items], strict)
                else:
                    made = self.create(target, items, strict)
                    ids = [r[0] for r in made.select(f"`{f.relation.target_column}`").collect()]
                    self.relate(e, f, [own], {"connect": ids})
        return fresh

    def _refuse_known(self, e: Entity, df: DataFrame, rows: list[dict[str, Any]]) -> None:
        keys = [tuple(r.get(k) for k in e.key_columns) for r in rows]
        if len(set(keys)) < len(keys):
            raise QueryError(f"{e.name} is given the same key twice")
        schema = T.StructType([df.schema[k] for k in e.key_columns])
        wanted = self._frame([dict(zip(e.key_columns, k, strict=True)) for k in keys], schema, e)
        if not df.join(wanted, e.key_columns, "left_semi").isEmpty():
            raise QueryError(f"{e.name} has a row with that key already")

    # -- update

    def _matched(self, e: Entity, df: DataFrame, args: dict[str, Any]) -> tuple[Column, DataFrame]:
        found, flagged = self.planner.predicate(e, df, args)
        if found is None:
            if args.get("all") is not True:
                raise QueryError(f"mutation of all rows of {e.name} needs id, where or all: true")
            found = F.lit(True)
        return F.coalesce(found, F.lit(False)), flagged

    def update(self, e: Entity, given: dict[str, Any], args: dict[str, Any]) -> DataFrame:
        """The rows that match, after the change."""
        df = self.engine.rows(e, unscoped=True)
        values, related = self._split(e, given)
        if set(values) & set(e.key_columns):
            raise QueryError(f"the key of {e.name} cannot be changed")
        if stamped := set(values) & {CREATED, UPDATED}:
            raise QueryError(f"{min(stamped)} of {e.name} is stamped and cannot be changed")
        found, flagged = self._matched(e, df, args)
        if e.deleted_at and e.deleted_at in df.columns:
            found = found & F.col(e.deleted_at).isNull()
        if related:
            ids = flagged.where(found)
            for f, v in related:
                keys = [r[0] for r in ids.select(f"`{f.relation.source_column}`").collect()] if f.relation.kind != MANY_TO_ONE else []
                if f.relation.kind == MANY_TO_ONE:
                    to = v.get("connect") if isinstance(v, dict) else v
                    gone = isinstance(v, dict) and not to and v.get("disconnect")
                    values[f.relation.source_column] = None if gone else (to[0] if isinstance(to, list) else to)
                else:
                    self.relate(e, f, keys, v)
        marked = flagged.withColumn("__hit", found)
        schema = df.schema
        changes = {c: typed_literal(v, schema[c].dataType, c) for c, v in values.items()}
        changes = self._stamps(df, UPDATED, UPDATED_BY) | changes
        for c, new in changes.items():
            marked = marked.withColumn(c, F.when(F.col("__hit"), new).otherwise(F.col(f"`{c}`")))
        self.engine.replace(e, marked.select(*[f"`{c}`" for c in df.columns]))
        return marked.where("__hit").select(*[f"`{c}`" for c in df.columns])

    # -- delete

    def delete(self, e: Entity, args: dict[str, Any]) -> DataFrame:
        """The rows that match, as they were. An entity with soft deletion keeps them, stamped."""
        df = self.engine.rows(e, unscoped=True)
        found, flagged = self._matched(e, df, args)
        soft = e.deleted_at if e.deleted_at in df.columns and not args.get("unscoped") else ""
        if soft:
            found = found & F.col(f"`{soft}`").isNull()
        marked = flagged.withColumn("__hit", found)
        gone = marked.where("__hit").select(*[f"`{c}`" for c in df.columns])
        if soft:
            left = marked
            for c, new in self._stamps(df, soft, DELETED_BY).items():
                left = left.withColumn(c, F.when(F.col("__hit"), new).otherwise(F.col(f"`{c}`")))
        else:
            left = marked.where(~F.col("__hit"))
        self.engine.replace(e, left.select(*[f"`{c}`" for c in df.columns]))
        return gone

    # -- upsert

    def upsert(self, e: Entity, given: Any, where: dict[str, Any] | None) -> DataFrame:
        """Insert, or on a known key update the given fields, where ``where`` holds for the row that is there. Returns the rows inserted or updated."""
        if not e.key_columns:
            raise QueryError(f"{e.name} has no key to upsert by")
        df = self.engine.rows(e, unscoped=True)
        inputs = [self._split(e, one)[0] for one in (given if isinstance(given, list) else [given])]
        for values in inputs:
            if any(values.get(k) is None for k in e.key_columns):
                raise QueryError(f"upsert of {e.name} needs its key")
        keys = [tuple(v[k] for k in e.key_columns) for v in inputs]
        if len(set(keys)) < len(keys):
            raise QueryError(f"{e.name} is given the same key twice")
        incoming = self._frame(inputs, df.schema, e)
        told = T.StructType([T.StructField("__key", T.IntegerType())] + [T.StructField(f"__has_{c}", T.BooleanType()) for c in df.columns])
        flags = self.engine.spark.createDataFrame([(i, *[c in v for c in df.columns]) for i, v in enumerate(inputs)], told)
        numbered = self.engine.spark.createDataFrame([(*[_python(v[k], df.schema[k].dataType, k) for k in e.key_columns], i) for i, v in enumerate(inputs)], T.StructType([T.StructField(k, df.schema[k].dataType) for k in e.key_columns] + [T.StructField("__key", T.IntegerType())]))
        new = incoming.join(numbered, e.key_columns).join(flags, "__key").select(*[F.col(f"`{c}`").alias(c if c in e.key_columns else f"__new_{c}") for c in df.columns], *[f"__has_{c}" for c in df.columns], F.lit(True).alias("__in"))
        guard, flagged = self.planner.predicate(e, df, {"where": where} if where else {})
        flagged = flagged.withColumn("__may", F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True))
        # the inputs are literals of this operation; Spark sees their size and broadcasts them while they are small
        known = flagged.join(new, e.key_columns, "left")
        hit = F.coalesce(F.col("__in") & F.col("__may"), F.lit(False))
        stamps = self._stamps(df, UPDATED, UPDATED_BY)
        outs = []
        for c in df.columns:
            if c in e.key_columns:
                outs.append(F.col(f"`{c}`"))
                continue
            has = F.coalesce(F.col(f"__has_{c}"), F.lit(False))
            changed = F.when(hit & has, F.col(f"__new_{c}"))
            if c in stamps:
                changed = changed.when(hit, stamps[c])
            outs.append(changed.otherwise(F.col(f"`{c}`")).alias(c))
        old = known.select(*outs, hit.alias("__hit"))
        made = self._stamps(df, CREATED, CREATED_BY)
        own = [F.col(f"`{c}`") if c in e.key_columns else F.when(F.col(f"__has_{c}"), F.col(f"__new_{c}")).otherwise(made[c]).alias(c) if c in made else F.col(f"__new_{c}").alias(c) for c in df.columns]
        fresh = new.join(df.select(*[f"`{k}`" for k in e.key_columns]), e.key_columns, "left_anti").select(*own, F.lit(True).alias("__hit"))
        result = old.unionByName(fresh)
        self.engine.replace(e, result.drop("__hit"))
        return result.where("__hit").drop("__hit")

    # -- relations

    def relate(self, e: Entity, f: Field, keys: list[Any], change: dict[str, Any]) -> None:
        """Connect and disconnect: rows of the bridge, or foreign keys of the children."""
        if not isinstance(change, dict) or set(change) - {"id", "connect", "disconnect"}:
            raise QueryError(f"relation {f.name} takes connect and disconnect")
        r = f.relation
        listed = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        connect, cut = listed(change.get("connect")), listed(change.get("disconnect"))
        if r.kind == MANY_TO_MANY:
            bridge = self.engine.catalog.entity(r.through.table)
            df = self.engine.rows(bridge, unscoped=True)
            pair = T.StructType([df.schema[r.through.source_key], df.schema[r.through.target_key]])
            frame = lambda ids: self._frame([{r.through.source_key: k, r.through.target_key: i} for k in keys for i in ids], pair, bridge)
            out = df
            if cut:
                out = out.join(frame(cut), pair.names, "left_anti")
            if connect:
                out = out.unionByName(frame(connect).join(out, pair.names, "left_anti"), allowMissingColumns=True)
            self.engine.replace(bridge, out.select(*[f"`{c}`" for c in df.columns]))
            return
        target = self.engine.catalog.entity(r.target)
        df = self.engine.rows(target, unscoped=True)
        key, fk = F.col(f"`{target.key_columns[0]}`"), F.col(f"`{r.target_column}`")
        kind, link = df.schema[target.key_columns[0]].dataType, df.schema[r.target_column].dataType
        new = fk
        if cut:
            mine = fk.isin(*[typed_literal(k, link, f.name) for k in keys])
            new = F.when(key.isin(*[typed_literal(i, kind, f.name) for i in cut]) & mine, F.lit(None).cast(link)).otherwise(new)
        if connect:
            if len(keys) != 1:
                raise QueryError(f"connect of {f.name} needs exactly one {e.name}")
            new = F.when(key.isin(*[typed_literal(i, kind, f.name) for i in connect]), typed_literal(keys[0], link, f.name)).otherwise(new)
        self.engine.replace(target, df.withColumn(r.target_column, new))
