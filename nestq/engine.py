"""The engine: GraphQL text in, DataFrames or nested results out."""

from __future__ import annotations

import base64
import datetime as dt
import json
import time
from decimal import Decimal
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from nestq.errors import QueryError
from nestq.functions.resolvers import Resolvers
from nestq.functions.values import encode_cursor
from nestq.operators import ordering, stats
from nestq.operators.mutate import Mutations
from nestq.operators.predicates import condition
from nestq.plans.introspect import introspect
from nestq.plans.lang import Document, Field, Operation, bound_variables, fields_of, parse, pick_operation
from nestq.plans.planner import LIST_ARGS, Planner
from nestq.sources.catalog import Catalog, Entity
from nestq.sources.naming import lower_camel, plural
from nestq.sources.shared import written

CACHE_SECONDS = 30 * 60
#: Operations after which the image of an entity they changed is written out.
IMAGE_STEPS = 8


def message_of(error: Exception) -> str:
    """What a caller is told of an error: its first line, without the cluster's stack."""
    if isinstance(error, Py4JJavaError):
        cause = error.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        text = cause.getMessage() or cause.getClass().getName()
    else:
        text = str(error) or type(error).__name__
    return text.strip().split("\n")[0]


def plain(value: Any) -> Any:
    """A collected value as JSON has it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    return value


class Engine:
    """``execute`` answers like a GraphQL server; ``frame`` gives the lazy DataFrame of one root field."""

    def __init__(self, spark: SparkSession, catalog: Catalog, resolvers: Resolvers | None = None, cache: bool = False):
        self.spark, self.catalog = spark, catalog
        self.resolvers = resolvers or Resolvers()
        self.images: dict[str, DataFrame] = {}  # what mutations have made of tables
        self.steps: dict[str, int] = {}
        self.user: Any = None  # who creations, changes and deletions are stamped with
        self.cache_on = cache
        self.results: dict[str, tuple[float, set[str], Any]] = {}
        self.hits = 0

    # -- data

    def rows(self, e: Entity, unscoped: bool = False) -> DataFrame:
        """The entity's current rows, without soft-deleted ones unless unscoped."""
        df = self.images.get(e.table or e.name)
        if df is None:
            df = self.catalog.frame(self.spark, e)
        if e.deleted_at and e.deleted_at in df.columns and not unscoped:
            df = df.where(F.col(f"`{e.deleted_at}`").isNull())
        return df

    def replace(self, e: Entity, df: DataFrame) -> None:
        """A new image of the entity; cached results that read it go."""
        name = e.table or e.name
        self.images[name] = df
        self.results = {k: v for k, v in self.results.items() if name not in v[1]}

    def commit(self, e: Entity | str, path: str) -> DataFrame:
        """Write an entity's image as Parquet and read on from there."""
        e = self.catalog.entity(e) if isinstance(e, str) else e
        self.rows(e, unscoped=True).write.mode("errorifexists").parquet(path)
        self.images[e.table or e.name] = self.spark.read.parquet(path)
        return self.images[e.table or e.name]

    # -- roots

    def root_entity(self, name: str) -> tuple[Entity, str]:
        """(entity, form): ``page`` (items, total, pageInfo), ``list``, ``one`` or ``stats``."""
        for e in self.catalog.entities.values():
            one, many = lower_camel(e.name), lower_camel(plural(e.name))
            if name == many:
                return e, "page"
            if name in (f"{one}Stats", f"{many}Stats"):
                return e, "stats"
            if name == f"{one}List":
                return e, "list"
            if name == one:
                return e, "one"
        raise QueryError(f"unknown query field {name}")

    def mutation_entity(self, name: str) -> tuple[Entity, str]:
        for verb in ("create", "update", "delete", "upsert", "batchDelete"):
            if name.startswith(verb):
                for e in self.catalog.entities.values():
                    if name[len(verb) :] in (e.name, plural(e.name)):
                        return e, verb
        e, form = self.root_entity(name)
        if form != "list":
            raise QueryError(f"unknown mutation field {name}")
        return e, "list"

    # -- results

    def execute(self, text: str, variables: dict[str, Any] | None = None, operation_name: str | None = None, user: Any = None) -> dict[str, Any]:
        """``{"data": ..., "errors": [...]}``; data is null when anything fails, in the query or on the cluster. Mutations of a failed operation are undone.

        ``user`` goes into created_by, updated_by and deleted_by where an entity has them.
        """
        images = dict(self.images)
        self.user = user
        try:
            document = parse(text)
            op = pick_operation(document, operation_name)
            values = bound_variables(op, variables)
            key = json.dumps([op.kind, text, variables, op.name], sort_keys=True, default=str)
            if self.cache_on and op.kind != "mutation" and (found := self.results.get(key)) and found[0] > time.monotonic():
                self.hits += 1
                data = found[2]
            else:
                planner = Planner(self, document, values, self.catalog.options.default_limit)
                data = self._run(op, planner)
                if self.cache_on and op.kind != "mutation":
                    self.results[key] = (time.monotonic() + CACHE_SECONDS, set(planner.touched), data)
        except Exception as e:  # whatever fails, here or on the cluster, is an error of the operation
            return {"data": None, "errors": [{"message": message_of(e)}]}
        else:
            if op.kind == "mutation":
                self._settle(images)
            images = self.images
        finally:
            self.images = images
        nested = op.name and self.catalog.options.nest_under_operation
        return {"data": {op.name: data} if nested else data, "errors": []}

    def _settle(self, before: dict[str, DataFrame]) -> None:
        """Images are plans upon plans; after every IMAGE_STEPS operations that changed it, an entity's is written to the shared folder."""
        for name, df in self.images.items():
            if df is not before.get(name):
                self.steps[name] = self.steps.get(name, 0) + 1
                if self.steps[name] >= IMAGE_STEPS:
                    self.images[name], self.steps[name] = written(df, "image"), 0

    def _run(self, op: Operation, planner: Planner) -> dict[str, Any]:
        roots = fields_of(op.selection, planner.document, planner.variables)
        out: dict[str, Any] = {}
        for s in roots:
            if s.name == "__typename":
                out[s.key] = "Mutation" if op.kind == "mutation" else "Query"
            elif s.name in ("__schema", "__type"):
                out[s.key] = introspect(self.catalog, s, planner.fields, planner.variables)
            elif op.kind == "mutation":
                out[s.key] = self._mutate(s, planner)
            else:
                out[s.key] = self._query(s, planner)
        return out

    def _query(self, s: Field, planner: Planner) -> Any:
        e, form = self.root_entity(s.name)
        if form == "stats":
            return self._stats(e, s, planner)
        planner.check_args(e, s.name, s.args)
        inner = planner.fields(s.selection, e.name)
        if form == "page":
            return self._page(e, s, planner)
        rows, _ = planner.page(e, s, inner)
        if form == "one":
            found = rows.limit(1).collect()
            return plain(found[0]["__row"]) if found else None
        return self._collected(rows)

    @staticmethod
    def _collected(rows: DataFrame) -> list[Any]:
        return [plain(r["__row"]) for r in rows.collect()]

    def _page(self, e: Entity, s: Field, planner: Planner) -> dict[str, Any]:
        out: dict[str, Any] = {}
        selected = planner.fields(s.selection, f"{e.name}Result")
        page = None
        for f in selected:
            if f.name not in ("items", "total", "pageInfo", "__typename"):
                raise QueryError(f"unknown field {f.name} of {e.name}Result")
        if any(f.name in ("items", "pageInfo") for f in selected):
            items = [x for f in selected if f.name == "items" for x in f.selection]
            inner = planner.fields(items, e.name) if items else [Field("__typename")]
            more = any(f.name == "pageInfo" for f in selected)
            rows, p = planner.page(e, s, inner, extra=1 if more else 0)
            found = rows.collect()
            over = p.limit is not None and len(found) > p.limit
            if over:
                found = found[1:] if p.backward else found[:-1]
            page = (found, p, over)
        for f in selected:
            if f.name == "__typename":
                out[f.key] = f"{e.name}Result"
            elif f.name == "total":
                out[f.key] = planner.filtered(e, s.args).count()
            elif f.name == "items":
                out[f.key] = [plain(r["__row"]) for r in page[0]]
            else:
                out[f.key] = self._page_info(e, planner.fields(f.selection, "PageInfo"), *page)
        return out

    @staticmethod
    def _page_info(e: Entity, fields: list[Field], rows: list[Row], p: ordering.Paging, over: bool) -> dict[str, Any]:
        def cursor(r: Row) -> str | None:
            named = {f.name: plain(r[f.column]) for f in e.columns if f.column in e.key_columns}
            return encode_cursor(named) if named else None

        facts = {
            "hasNext": over if not p.backward else p.before is not None,
            "hasPrev": over if p.backward else p.offset > 0 or p.after is not None,
            "start": cursor(rows[0]) if rows else None,
            "end": cursor(rows[-1]) if rows else None,
            "__typename": "PageInfo",
        }
        try:
            return {f.key: facts[f.name] for f in fields}
        except KeyError as x:
            raise QueryError(f"unknown field {x.args[0]} of PageInfo") from None

    # -- statistics

    def stats_frames(self, e: Entity, s: Field, planner: Planner) -> tuple[DataFrame | None, list[tuple[Field, DataFrame]]]:
        """(the frame of the plain aggregates, the frame of each groupBy selection)."""
        planner.check_args(e, s.name, s.args, {"where", "filter", "groupBy", "id", "unscoped"})
        df = planner.filtered(e, s.args)
        fields = planner.fields(s.selection, f"{e.name}Stats")
        filtered = lambda tree: condition(e, df, tree)
        inner = lambda f: planner.fields(f.selection)
        own = [f for f in fields if f.name not in ("groupBy", "__typename")]
        made = stats.selected_aggregates(e, df, own, inner, filtered)
        whole = stats.whole(df, made) if made else None
        grouped = []
        for f in fields:
            if f.name == "groupBy":
                by = f.args or s.args.get("groupBy")
                if not by:
                    raise QueryError("groupBy needs the argument groupBy")
                below = [x for x in planner.fields(f.selection) if x.name not in ("key", "__typename")]
                grouped.append((f, stats.groups(e, df, by, stats.selected_aggregates(e, df, below, inner, filtered))))
        return whole, grouped

    def _stats(self, e: Entity, s: Field, planner: Planner) -> dict[str, Any]:
        whole, grouped = self.stats_frames(e, s, planner)
        values = plain(whole.first()) if whole is not None else {}
        for f, df in grouped:
            keys = [x.key for x in planner.fields(f.selection) if x.name == "key"]
            rows = []
            for r in df.collect():
                row = plain(r)
                key = row.pop("key")
                rows.append({**{k: key for k in keys}, **row})
            values[f.key] = rows
        names = [f.key for f in planner.fields(s.selection) if f.name != "__typename"]
        return {n: values[n] for n in names}

    # -- mutations

    def _mutate(self, s: Field, planner: Planner) -> Any:
        e, verb = self.mutation_entity(s.name)
        if e.virtual:
            raise QueryError(f"{e.name} is virtual and cannot be changed")
        m = Mutations(planner)
        args = s.args
        if verb == "list":
            return self._list_mutation(e, s, m, planner)
        if verb in ("delete", "batchDelete"):
            planner.check_args(e, s.name, args, {"id", "where", "filter", "all", "unscoped"})
            gone = m.delete(e, args)
            return self._mutated(e, gone, s, planner) if s.selection else gone.count()
        given = args.get("input")
        if given is None:
            raise QueryError(f"{s.name} needs input")
        planner.check_args(e, s.name, args, {"input"} if verb == "create" else {"input", "id", "where", "all"})
        if verb == "create":
            rows = self._mutated(e, m.create(e, given), s, planner)
            return rows if isinstance(given, list) else rows[0]
        if verb == "upsert":
            rows = self._mutated(e, m.upsert(e, given, args.get("where")), s, planner)
            return rows if isinstance(given, list) else rows[0] if rows else None
        rows = self._mutated(e, m.update(e, given, args), s, planner)
        return rows[0] if rows else None

    def _list_mutation(self, e: Entity, s: Field, m: Mutations, planner: Planner) -> list[Any]:
        """The forms that hang on a list field: insert, upsert, update and delete."""
        args = s.args
        planner.check_args(e, s.name, args, LIST_ARGS | {"insert", "upsert", "update", "delete", "all"})
        forms = [n for n in ("insert", "upsert", "update", "delete") if args.get(n)]
        if len(forms) != 1:
            raise QueryError(f"{s.name} needs one of insert, upsert, update, delete")
        if forms[0] == "insert":
            rows = m.create(e, args["insert"], strict=False)
        elif forms[0] == "upsert":
            rows = m.upsert(e, args["upsert"], args.get("where"))
        elif forms[0] == "update":
            rows = m.update(e, args["update"], args)
        else:
            rows = m.delete(e, args)
        return self._mutated(e, rows, s, planner)

    def _mutated(self, e: Entity, rows: DataFrame, s: Field, planner: Planner) -> list[Any]:
        inner = planner.fields(s.selection, e.name) if s.selection else [Field(f.name) for f in e.columns if f.column in rows.columns]
        order = [F.col(f"`{k}`") for k in e.key_columns]
        out = planner.project(e, rows, inner, e.key_columns)
        return [plain(r["__row"]) for r in (out.orderBy(*order) if order else out).collect()]

    # -- frames

    def frame(self, text: str, variables: dict[str, Any] | None = None, operation_name: str | None = None) -> DataFrame:
        """The lazy, flat DataFrame of the operation's only root field. There is no default limit.

        A page or list has a column per selected field (structs and arrays of structs for relations); statistics have one row, groups
        the group's fields and the aggregates; a mutation has the rows it touched.
        """
        document: Document = parse(text)
        op = pick_operation(document, operation_name)
        planner = Planner(self, document, bound_variables(op, variables), None)
        roots = fields_of(op.selection, document, planner.variables)
        if len(roots) != 1:
            raise QueryError("frame needs exactly one root field")
        return self._frame(roots[0], op, planner)

    def frames(self, text: str, variables: dict[str, Any] | None = None, operation_name: str | None = None) -> dict[str, DataFrame]:
        """A frame per root field, by response key."""
        document = parse(text)
        op = pick_operation(document, operation_name)
        planner = Planner(self, document, bound_variables(op, variables), None)
        return {s.key: self._frame(s, op, planner) for s in fields_of(op.selection, document, planner.variables)}

    def _frame(self, s: Field, op: Operation, planner: Planner) -> DataFrame:
        if op.kind == "mutation":
            return self._mutation_frame(s, planner)
        e, form = self.root_entity(s.name)
        if form == "stats":
            whole, grouped = self.stats_frames(e, s, planner)
            if grouped:
                df = grouped[0][1]
                return df.select("key.*", *[c for c in df.columns if c != "key"])
            return whole
        planner.check_args(e, s.name, s.args)
        selection = s.selection
        if form == "page":
            selected = planner.fields(s.selection)
            if [f.name for f in selected] == ["total"]:
                return planner.filtered(e, s.args).agg(F.count(F.lit(1)).alias(selected[0].key))
            selection = [x for f in selected if f.name == "items" for x in f.selection]
        rows, _ = planner.page(e, s, planner.fields(selection, e.name))
        return (rows.limit(1) if form == "one" else rows).select("__row.*")

    def _mutation_frame(self, s: Field, planner: Planner) -> DataFrame:
        e, verb = self.mutation_entity(s.name)
        m, args = Mutations(planner), s.args
        if verb == "create" or args.get("insert"):
            rows = m.create(e, args.get("input") or args.get("insert"), strict=verb == "create")
        elif verb == "update" or args.get("update"):
            rows = m.update(e, args.get("input") or args.get("update"), args)
        elif verb == "upsert" or args.get("upsert"):
            rows = m.upsert(e, args.get("input") or args.get("upsert"), args.get("where"))
        else:
            rows = m.delete(e, args)
            if not s.selection:
                return rows.agg(F.count(F.lit(1)).alias(s.key))
        inner = planner.fields(s.selection, e.name) if s.selection else [Field(f.name) for f in e.columns if f.column in rows.columns]
        return planner.project(e, rows, inner, []).select("__row.*")

    def image(self, name: str) -> DataFrame:
        """An entity's rows as mutations left them, soft-deleted ones included."""
        return self.rows(self.catalog.entity(name), unscoped=True)

    def lineage(self, text: str, variables: dict[str, Any] | None = None) -> set[str]:
        """The tables a query reads."""
        document = parse(text)
        op = pick_operation(document, None)
        planner = Planner(self, document, bound_variables(op, variables), None)
        for s in fields_of(op.selection, document, planner.variables):
            self._frame(s, op, planner)
        return planner.touched
