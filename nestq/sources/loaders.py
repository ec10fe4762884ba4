"""Where catalogs come from: tables and their keys, databases, a JSON snapshot, a configuration."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from nestq.errors import QueryError
from nestq.sources.catalog import Catalog, Entity, Field, Relation, Through, relation_kind, scalar_of
from nestq.sources.naming import field_name


class TableSource:
    """Entities of DataFrames: types come from the schemas, keys are declared, since files hold none.

    ``keys``: table -> {"primary": [...], "foreign": {column: "table.column"}, "unique": [...]}.
    """

    name, priority = "tables", 60

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[SparkSession], DataFrame]], keys: dict[str, dict] | None = None):
        self.spark, self.tables, self.keys = spark, tables, keys or {}

    def supported(self) -> bool:
        return bool(self.tables)

    def load(self, catalog: Catalog) -> None:
        for table, frame in self.tables.items():
            keys = self.keys.get(table, {})
            schema = (frame if isinstance(frame, DataFrame) else frame(self.spark)).schema
            columns = [(f.name, "json" if f.name in keys.get("json", ()) else f.dataType, f.nullable) for f in schema]
            if catalog.add_table(table, columns, keys.get("primary", ()), keys.get("unique", ())):
                catalog.bind(table, frame)
        for table, keys in self.keys.items():
            for column, to in keys.get("foreign", {}).items():
                other, _, other_column = to.partition(".")
                catalog.add_foreign_key(table, column, other, other_column)


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """One Parquet table per name in a folder."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


class JdbcSource:
    """Entities of a PostgreSQL or MySQL database, read through Spark's JDBC source (the driver's jar must be on the class path)."""

    name, priority = "jdbc", 60
    SCHEMES = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql"}

    def __init__(self, spark: SparkSession, url: str, schema: str = "public", options: dict[str, str] | None = None, reader: Callable[[str], DataFrame] | None = None):
        self.spark, self.schema, self.options = spark, schema, options or {}
        scheme, _, rest = url.removeprefix("jdbc:").partition("://")
        if scheme not in self.SCHEMES:
            raise QueryError(f"unknown database scheme {scheme!r}")
        self.dialect = self.SCHEMES[scheme]
        self.url = f"jdbc:{self.dialect}://{rest}"
        self.reader = reader or self._read

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options).load()

    def supported(self) -> bool:
        return True

    def _query(self, sql: str) -> list[Any]:
        return self.reader(f"({sql}) AS q").collect()

    def load(self, catalog: Catalog) -> None:
        where = f"table_schema = '{self.schema}'"
        columns = self._query(f"SELECT table_name, column_name, data_type, is_nullable, ordinal_position FROM information_schema.columns WHERE {where}")
        keys = self._query(
            "SELECT k.table_name, k.column_name, c.constraint_type, k.constraint_name, k.ordinal_position FROM information_schema.key_column_usage k "
            f"JOIN information_schema.table_constraints c ON c.constraint_name = k.constraint_name AND c.table_name = k.table_name AND c.table_schema = k.table_schema WHERE k.{where}"
        )
        if self.dialect == "mysql":
            foreign = self._query(f"SELECT table_name, column_name, referenced_table_name AS other, referenced_column_name AS other_column FROM information_schema.key_column_usage WHERE {where} AND referenced_table_name IS NOT NULL")
        else:
            foreign = self._query(
                "SELECT k.table_name, k.column_name, u.table_name AS other, u.column_name AS other_column FROM information_schema.referential_constraints r "
                "JOIN information_schema.key_column_usage k ON k.constraint_name = r.constraint_name AND k.constraint_schema = r.constraint_schema "
                "JOIN information_schema.key_column_usage u ON u.constraint_name = r.unique_constraint_name AND u.constraint_schema = r.unique_constraint_schema AND u.ordinal_position = k.position_in_unique_constraint "
                f"WHERE k.{where}"
            )
        for table in sorted({r["table_name"] for r in columns}):
            own = sorted((r for r in columns if r["table_name"] == table), key=lambda r: r["ordinal_position"])
            of = lambda kind, t=table: [r["column_name"] for r in sorted(keys, key=lambda r: r["ordinal_position"]) if r["table_name"] == t and r["constraint_type"] == kind]
            if catalog.add_table(table, [(r["column_name"], r["data_type"], r["is_nullable"] == "YES") for r in own], of("PRIMARY KEY"), of("UNIQUE")):
                name = f"{self.schema}.{table}"
                catalog.bind(table, lambda _, name=name: self.reader(name))
        for r in foreign:
            catalog.add_foreign_key(r["table_name"], r["column_name"], r["other"], r["other_column"])


def save_snapshot(catalog: Catalog, path: str, version: str = "") -> None:
    """Write the catalog as JSON."""
    body = {"version": version, "entities": [dataclasses.asdict(e) for e in catalog.entities.values()]}
    Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=1))


class SnapshotSource:
    """Entities of a JSON snapshot; relations come with it. Data must be bound to its tables."""

    name, priority = "snapshot", 80

    def __init__(self, path: str):
        self.path = path

    def supported(self) -> bool:
        return Path(self.path).is_file()

    def load(self, catalog: Catalog) -> None:
        body = json.loads(Path(self.path).read_text())
        catalog.version = body.get("version", "")
        for d in body["entities"]:
            fields = {}
            for name, f in d.pop("fields").items():
                r = f.pop("relation")
                if r:
                    r["through"] = Through(**r["through"]) if r["through"] else None
                fields[name] = Field(**f, relation=Relation(**r) if r else None)
            catalog.put(Entity(**d, fields=fields))


class ConfigSource:
    """Classes, fields and relations of a configuration, laid over what other sources gave.

    ``{"classes": {Name: {...}}}`` where a class has ``table`` (a known one: an alias or, with ``override``, a
    replacement of the canonical class), or none (virtual, with a ``resolver``), ``include_fields``,
    ``exclude_fields``, ``primary_keys``, ``description``, ``deleted_at`` and ``fields``: {name: {column, type, description,
    nullable, primary, unique, virtual, resolver, relation: {type, target_class, source_column, target_column, through: {table, source_key,
    target_key}, reverse}}}.
    """

    name, priority = "config", 100

    def __init__(self, config: dict[str, Any]):
        self.config = config

    def supported(self) -> bool:
        return bool(self.config.get("classes"))

    def load(self, catalog: Catalog) -> None:
        classes = self.config["classes"]
        order = {"canonical": 0, "override": 1, "alias": 2, "virtual": 3}
        for name in sorted(classes, key=lambda n: order[self._kind(catalog, n, classes[n])]):
            self._class(catalog, name, classes[name])

    @staticmethod
    def _kind(catalog: Catalog, name: str, c: dict) -> str:
        if name in catalog.entities:
            return "canonical"
        if not c.get("table"):
            return "virtual"
        return "override" if c.get("override") else "alias"

    def _class(self, catalog: Catalog, name: str, c: dict) -> None:
        kind = self._kind(catalog, name, c)
        table = c.get("table", "")
        if kind == "canonical":
            e = catalog.entities[name]
        elif table in catalog.tables:
            e = catalog.clone(name, catalog.entity(table))
        else:
            e = Entity(name, table, virtual=not table)
        include, exclude = c.get("include_fields"), c.get("exclude_fields", [])
        if include or exclude:
            e.fields = {n: f for n, f in e.fields.items() if (not include or n in include or f.column in include) and n not in exclude and f.column not in exclude}
        e.description = c.get("description", e.description)
        e.resolver = c.get("resolver", e.resolver)
        e.deleted_at = c.get("deleted_at", e.deleted_at)
        e.primary_keys = c.get("primary_keys", e.primary_keys)
        for fname, f in c.get("fields", {}).items():
            self._field(catalog, e, fname, f)
        for f in e.columns:
            f.primary = f.primary or f.column in e.primary_keys
        if kind == "override":
            old = catalog.tables.get(table)
            if old and old != name:
                catalog.entities.pop(old, None)
        catalog.put(e, table_index=kind in ("canonical", "override") or table not in catalog.tables)

    @staticmethod
    def _field(catalog: Catalog, e: Entity, name: str, f: dict) -> None:
        if r := f.get("relation"):
            t = r.get("through")
            through = Through(t["table"], t["source_key"], t["target_key"]) if t else None
            relation = Relation(relation_kind(r.get("type", "")), r["source_column"], r["target_class"], r["target_column"], through, bool(r.get("up")))
            catalog.declared.append((e.name, name, relation))
            if r.get("reverse"):
                back = {"ManyToOne": "OneToMany", "OneToMany": "ManyToOne"}.get(relation.kind, relation.kind)
                turned = Through(t["table"], t["target_key"], t["source_key"]) if t else None
                catalog.declared.append((r["target_class"], r["reverse"], Relation(back, relation.target_column, e.name, relation.source_column, turned)))
            return
        column = f.get("column", "")
        base = e.find(name) or (e.find(column) if column else None)
        if base and column and base.name != name and not f.get("alias"):
            del e.fields[base.name]  # the column gets another name
        if base:
            field = dataclasses.replace(base, name=name)
        else:
            field = Field(name, "String", column, virtual=not column)
        field.column = column or field.column
        field.virtual = f.get("virtual", not field.column)
        if "type" in f:
            field.type = scalar_of(f["type"])
        for k in ("description", "nullable", "primary", "unique", "resolver"):
            if k in f:
                setattr(field, k, f[k])
        e.add(field)


def strip_prefix(prefix: str, column: str) -> str:
    return field_name(column, [prefix])
