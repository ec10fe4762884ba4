"""Selections bound to the catalog and lowered to DataFrames.

A selection becomes one DataFrame with a struct column ``__row``. To-many relations are built from the
leaves up: filter, number per parent, gather by foreign key, join. Nothing is collected.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.errors import QueryError
from nestq.functions.values import typed_literal
from nestq.operators import ordering, relations
from nestq.operators.predicates import condition
from nestq.plans.lang import Document, Field, fields_of
from nestq.sources.catalog import MANY_TO_MANY, MANY_TO_ONE, RECURSIVE, Entity
from nestq.sources.catalog import Field as EntityField

if TYPE_CHECKING:
    from nestq.engine import Engine

LIST_ARGS = {"id", "where", "filter", "sort", "orderBy", "limit", "offset", "first", "last", "after", "before", "distinct", "level", "unscoped"}


class Planner:
    def __init__(self, engine: Engine, document: Document, variables: dict[str, Any], default_limit: int | None):
        self.engine, self.document, self.variables, self.default_limit = engine, document, variables, default_limit
        self.count = 0
        self.touched: set[str] = set()

    # -- helpers

    def fields(self, selection: list[Any], type_name: str | None = None) -> list[Field]:
        return fields_of(selection, self.document, self.variables, type_name)

    def fresh(self, kind: str) -> str:
        self.count += 1
        return f"__{kind}{self.count}"

    def source(self, e: Entity, unscoped: bool = False) -> DataFrame:
        self.touched.add(e.table or e.name)
        return self.engine.rows(e, unscoped)

    def check_args(self, e: Entity, name: str, args: dict[str, Any], allowed: set[str] = LIST_ARGS) -> None:
        unknown = set(args) - allowed
        if unknown:
            raise QueryError(f"unknown argument {sorted(unknown)[0]} of {name}")

    # -- filters

    def filtered(self, e: Entity, args: dict[str, Any], df: DataFrame | None = None) -> DataFrame:
        """The entity's rows that ``id`` and ``where`` leave."""
        df = self.source(e, bool(args.get("unscoped"))) if df is None else df
        found, df = self.predicate(e, df, args)
        if found is not None:
            df = df.where(found)
        return df.drop(*[c for c in df.columns if c.startswith("__has")])

    def predicate(self, e: Entity, df: DataFrame, args: dict[str, Any]) -> tuple[Column | None, DataFrame]:
        """The condition of ``id`` AND ``where``, and ``df`` with the flags that conditions on relations need."""
        holder = {"df": df}

        def nested(f: EntityField, tree: dict[str, Any]) -> Column:
            flag = self.fresh("has")
            keys, column = self.related_keys(f, tree)
            holder["df"] = relations.semi(holder["df"], column, keys, flag)
            return F.col(flag)

        parts = []
        if args.get("id") is not None:
            parts.append(self.key_equals(e, df, args["id"]))
        where = args.get("where") if args.get("where") is not None else args.get("filter")
        if where is not None:
            found = condition(e, df, where, nested)
            if found is not None:
                parts.append(found)
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out & p
        return out, holder["df"]

    def key_equals(self, e: Entity, df: DataFrame, value: Any) -> Column:
        keys = e.key_columns
        if not keys:
            raise QueryError(f"{e.name} has no primary key")
        if isinstance(value, dict):
            named = {e.find(k).column if e.find(k) else k: v for k, v in value.items()}
        elif len(keys) == 1:
            named = {keys[0]: value}
        else:
            raise QueryError(f"{e.name} has a composite key: id must be an object")
        if set(named) != set(keys):
            raise QueryError(f"id of {e.name} must name {', '.join(keys)}")
        out = None
        for k in keys:
            part = F.col(f"`{k}`") == typed_literal(named[k], df.schema[k].dataType, "id")
            out = part if out is None else out & part
        return out

    def related_keys(self, f: EntityField, tree: dict[str, Any]) -> tuple[DataFrame, str]:
        """(__fk: values of the parent's column for which a related row meets the tree, that column)."""
        r = f.relation
        target = self.engine.catalog.entity(r.target)
        rows = self.filtered(target, {"where": tree} if tree else {})
        if r.kind == MANY_TO_MANY:
            keys = relations.through_bridge(self.bridge(r.through.table), r.through.source_key, r.through.target_key, rows, r.target_column)
            return keys.select("__fk"), r.source_column
        return rows.select(F.col(f"`{r.target_column}`").alias("__fk")), r.source_column

    def bridge(self, table: str) -> DataFrame:
        return self.source(self.engine.catalog.entity(table))

    # -- projection

    def project(self, e: Entity, df: DataFrame, fields: list[Field], keep: list[str]) -> DataFrame:
        """``keep`` and ``__row``: the selected fields under their response keys."""
        outs: list[Column] = []
        for s in fields:
            if s.name == "__typename":
                outs.append(F.lit(e.name).alias(s.key))
                continue
            f = e.find(s.name)
            if f is None:
                raise QueryError(f"unknown field {s.name} of {e.name}")
            if f.relation:
                name = self.fresh("rel")
                df = self.attach(e, df, f, s, name)
                outs.append(F.col(name).alias(s.key))
                continue
            if s.selection:
                raise QueryError(f"field {s.name} of {e.name} has no fields of its own")
            if f.resolver:
                outs.append(self.engine.resolvers.column(f.resolver, df).alias(s.key))
            elif f.column in df.columns:
                outs.append(F.col(f"`{f.column}`").alias(s.key))
            else:
                raise QueryError(f"field {s.name} of {e.name} has neither column nor resolver")
        if not outs:
            raise QueryError(f"{e.name} needs a selection of fields")
        return df.select(*[F.col(f"`{k}`") for k in keep], F.struct(*outs).alias("__row"))

    def attach(self, e: Entity, df: DataFrame, f: EntityField, s: Field, name: str) -> DataFrame:
        r = f.relation
        target = self.engine.catalog.entity(r.target)
        if not s.selection:
            raise QueryError(f"relation {s.name} of {e.name} needs a selection")
        self.check_args(e, s.name, s.args)
        level = s.args.get("level", 1)
        if isinstance(level, bool) or not isinstance(level, int) or level < 0:
            raise QueryError("level must be a non-negative integer")
        deep = r.kind == RECURSIVE and (level != 1 or (r.up and f.list))
        if deep:
            return self.attach_recursive(e, df, f, s, name, level)
        children = self.filtered(target, s.args)
        if r.kind == MANY_TO_ONE or (r.kind == RECURSIVE and r.up):
            unique = target.key_columns == [r.target_column] or bool((t := target.find(r.target_column)) and t.unique)
            ones = children.withColumn("__fk", F.col(f"`{r.target_column}`"))
            if not unique:
                p = ordering.paging(target, s.args, None)
                p.limit = 1
                ones = ordering.paged_per_parent(ones, p, "__fk", target.key_columns)
            return relations.attach_one(df, r.source_column, self.project(target, ones, self.fields(s.selection, target.name), ["__fk"]), name)
        if r.kind == MANY_TO_MANY:
            children = relations.through_bridge(self.bridge(r.through.table), r.through.source_key, r.through.target_key, children, r.target_column)
        else:
            children = children.withColumn("__fk", F.col(f"`{r.target_column}`")).where("__fk is not null")
        return self.attach_children(target, df, r.source_column, children, s, name)

    def attach_children(self, target: Entity, df: DataFrame, column: str, children: DataFrame, s: Field, name: str, order: tuple[str, ...] = ()) -> DataFrame:
        p = ordering.paging(target, s.args, self.default_limit)
        if order and not p.keys[: len(p.keys) - len(target.key_columns)]:
            p.keys = [ordering.Key(c) for c in order] + p.keys
        children = ordering.keyset(target, children, p)
        tie = target.key_columns or [f.column for f in target.columns if f.column in children.columns and _orderable(children, f.column)]
        children = ordering.paged_per_parent(children, p, "__fk", tie)
        rows = self.project(target, children, self.fields(s.selection, target.name), ["__fk", "__rn"])
        return relations.attach_list(df, column, relations.gathered(rows), name)

    def attach_recursive(self, e: Entity, df: DataFrame, f: EntityField, s: Field, name: str, level: int) -> DataFrame:
        r = f.relation
        key = r.target_column if r.up else r.source_column  # the node's own key
        link = r.source_column if r.up else r.target_column  # its parent's key
        nodes = self.source(e)
        allowed = self.filtered(e, s.args).select(F.col(f"`{key}`").alias("__id")) if s.args.get("where") or s.args.get("id") else None
        links = relations.links_of(nodes, *((key, link) if r.up else (link, key)), allowed)
        roots = df.select(F.col(f"`{key}`").alias("__fk"), F.col(f"`{key}`").alias("__id")).distinct()
        reached = relations.walk(self.engine.spark, roots, links, level)
        children = self.filtered(e, {k: v for k, v in s.args.items() if k in ("where", "id")}).join(reached.withColumnRenamed("__id", "__nid"), F.col(f"`{key}`") == F.col("__nid")).drop("__nid")
        if not f.list:
            s = Field(s.name, s.alias, {**s.args, "limit": s.args.get("limit", 0)}, [], s.selection)
        return self.attach_children(e, df, key, children, s, name, ("__level",))

    # -- roots

    def page(self, e: Entity, s: Field, inner: list[Field], df: DataFrame | None = None, extra: int = 0) -> tuple[DataFrame, ordering.Paging]:
        """(key columns and ``__row`` of the page, in order; the paging)."""
        p = ordering.paging(e, s.args, self.default_limit)
        rows = ordering.paged(e, self.filtered(e, s.args, df), p, extra)
        joined = any((f := e.find(i.name)) is not None and f.relation for i in inner)
        keep = list(dict.fromkeys([k.column for k in p.keys] + e.key_columns))
        keep = [k for k in keep if k in rows.columns]
        out = self.project(e, rows, inner, keep)
        if p.keys and (joined or p.distinct or p.backward):
            out = out.orderBy(*[k.order() for k in p.keys])
        return out, p


def _orderable(df: DataFrame, column: str) -> bool:
    return not isinstance(df.schema[column].dataType, (T.MapType, T.VariantType))
