"""Entities, fields and relations, and how a catalog of them is put together from sources."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from nestq.errors import QueryError
from nestq.sources.naming import class_name, field_name, lower_camel, plural, upper_camel

MANY_TO_ONE, ONE_TO_MANY, MANY_TO_MANY, RECURSIVE = "ManyToOne", "OneToMany", "ManyToMany", "Recursive"
SCALARS = ("ID", "Int", "Date", "Json", "Float", "String", "Cursor", "Boolean", "DateTime")

#: Database types by scalar. Fixed values.
DATABASE_TYPES = {
    "Int": "smallint integer bigint int int2 int4 int8 smallserial serial bigserial serial2 serial4 serial8 tinyint mediumint year".split(),
    "Float": ["decimal", "numeric", "real", "float", "float4", "float8", "double", "double precision", "money"],
    "String": "char varchar character text tinytext mediumtext longtext enum set time bpchar name binary varbinary tinyblob blob mediumblob longblob".split() + ["character varying"],
    "Boolean": ["boolean", "bool", "tinyint(1)"],
    "ID": ["uuid", "serialid", "bigserialid"],
    "DateTime": ["date", "timestamp", "timestamptz", "datetime", "timestamp without time zone", "timestamp with time zone"],
    "Json": ["json", "jsonb"],
}
SCALAR_OF = {db: scalar for scalar, names in DATABASE_TYPES.items() for db in names}


def relation_kind(name: str) -> str:
    """Both spellings (``many_to_many``, ``ManyToMany``); ManyToOne when unknown."""
    found = upper_camel(name)
    return found if found in (ONE_TO_MANY, MANY_TO_MANY, RECURSIVE) else MANY_TO_ONE


def scalar_of(kind: str | T.DataType) -> str:
    """The scalar of a database type's name or of a Spark type."""
    if isinstance(kind, str):
        low = kind.lower().strip()
        return SCALAR_OF.get(low) or SCALAR_OF.get(re.sub(r"\(.*", "", low).strip()) or (kind if kind in SCALARS else "String")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Float"
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    if isinstance(kind, (T.VariantType, T.StructType, T.MapType, T.ArrayType)):
        return "Json"
    return "String"


@dataclass
class Through:
    table: str
    source_key: str  # bridge column that holds the source's key
    target_key: str


@dataclass
class Relation:
    kind: str
    source_column: str
    target: str
    target_column: str
    through: Through | None = None
    up: bool = False  # of a recursive relation: towards the parents


@dataclass
class Field:
    name: str
    type: str
    column: str = ""
    nullable: bool = True
    primary: bool = False
    unique: bool = False
    list: bool = False
    virtual: bool = False
    through: bool = False  # leads to a bridge
    relation: Relation | None = None
    resolver: str = ""
    description: str = ""


@dataclass
class Entity:
    name: str
    table: str = ""
    fields: dict[str, Field] = field(default_factory=dict)
    primary_keys: list[str] = field(default_factory=list)
    virtual: bool = False
    resolver: str = ""
    is_through: bool = False
    description: str = ""
    deleted_at: str = ""  # column of a soft delete

    def add(self, f: Field) -> Field:
        self.fields[f.name] = f
        return f

    def find(self, name: str) -> Field | None:
        """A field by its name or its column's."""
        return self.fields.get(name) or next((f for f in self.fields.values() if f.column == name and not f.relation), None)

    @property
    def columns(self) -> list[Field]:
        return [f for f in self.fields.values() if not f.relation]

    @property
    def relations(self) -> list[Field]:
        return [f for f in self.fields.values() if f.relation]

    @property
    def key_columns(self) -> list[str]:
        return list(self.primary_keys)


@dataclass
class Options:
    """What shapes names and queries."""

    schema: str = "public"
    default_limit: int | None = 10
    use_camel: bool = True
    use_singular: bool = True
    show_through: bool = True
    nest_under_operation: bool = True  # results of a named operation stand under its name
    table_prefixes: list[str] = field(default_factory=list)
    column_prefixes: dict[str, str] = field(default_factory=dict)  # by table
    exclude_tables: list[str] = field(default_factory=list)
    exclude_fields: list[str] = field(default_factory=list)
    type_mapping: dict[str, str] = field(default_factory=dict)


class CatalogSource(Protocol):
    """Sources run in order of priority; later ones override."""

    name: str
    priority: int

    def supported(self) -> bool: ...

    def load(self, catalog: Catalog) -> None: ...


class Catalog:
    """Entities by class name and by table name, and the DataFrames behind them."""

    def __init__(self, options: Options | None = None):
        self.options = options or Options()
        self.entities: dict[str, Entity] = {}
        self.tables: dict[str, str] = {}  # table -> class
        self.frames: dict[str, Callable[[SparkSession], DataFrame]] = {}  # by table, or by class for virtual ones
        self.foreign_keys: list[tuple[str, str, str, str]] = []  # table, column, other table, other column
        self.declared: list[tuple[str, str, Relation]] = []
        self.sources: list[CatalogSource] = []
        self.hooks: list[Callable[[Catalog], None]] = []
        self.version = ""

    # -- building

    def with_source(self, source: CatalogSource) -> Catalog:
        """Add a source, or replace the one of that name."""
        self.sources = [s for s in self.sources if s.name != source.name] + [source]
        return self

    def without_source(self, name: str) -> Catalog:
        self.sources = [s for s in self.sources if s.name != name]
        return self

    def with_hook(self, hook: Callable[[Catalog], None]) -> Catalog:
        """Called when all sources have loaded, before relations are made."""
        self.hooks.append(hook)
        return self

    def build(self) -> Catalog:
        for s in sorted(self.sources, key=lambda s: s.priority):
            if s.supported():
                s.load(self)
        for hook in self.hooks:
            hook(self)
        self._relate()
        return self

    def put(self, entity: Entity, table_index: bool = True) -> Entity:
        self.entities[entity.name] = entity
        if entity.table and table_index:
            self.tables[entity.table] = entity.name
        return entity

    def entity(self, name: str) -> Entity:
        """By class or table name."""
        found = self.entities.get(name) or self.entities.get(self.tables.get(name, ""))
        if not found:
            raise QueryError(f"unknown entity {name}")
        return found

    def add_table(
        self,
        table: str,
        columns: Iterable[tuple[str, Any, bool]],
        primary_keys: Iterable[str] = (),
        unique: Iterable[str] = (),
        comment: str = "",
        comments: dict[str, str] | None = None,
    ) -> Entity | None:
        """An entity for a table: columns are (name, type, nullable). Excluded tables give none."""
        o = self.options
        if table in o.exclude_tables:
            return None
        keys = list(primary_keys)
        e = Entity(class_name(table, o.table_prefixes, o.use_singular) if o.use_camel else table, table, primary_keys=keys, description=comment)
        prefix = [o.column_prefixes[table]] if table in o.column_prefixes else []
        for name, kind, nullable in columns:
            if name in o.exclude_fields:
                continue
            scalar = o.type_mapping.get(str(kind)) or scalar_of(kind)
            e.add(Field(field_name(name, prefix, o.use_camel), scalar, name, nullable and name not in keys, name in keys, name in set(unique) or keys == [name], description=(comments or {}).get(name, "")))
        return self.put(e)

    def add_foreign_key(self, table: str, column: str, other: str, other_column: str) -> None:
        if (table, column, other, other_column) not in self.foreign_keys:
            self.foreign_keys.append((table, column, other, other_column))

    # -- relations

    def _free(self, e: Entity, name: str) -> str:
        k, found = 0, name
        while found in e.fields:
            k += 1
            found = f"{name}{k}"
        return found

    def _relate(self) -> None:
        known = [fk for fk in self.foreign_keys if fk[0] in self.tables and fk[2] in self.tables]
        for table, column, other, other_column in known:
            child, parent = self.entity(table), self.entity(other)
            if child is parent:
                if re.search(r"(?:_id|Id|ID)$", column) or column == "pid":
                    self._link(child, "parent", parent.name, False, Relation(RECURSIVE, column, parent.name, other_column, up=True), nullable=True)
                    self._link(child, "children", parent.name, True, Relation(RECURSIVE, other_column, parent.name, column))
                continue
            own = child.find(column)
            self._link(child, lower_camel(parent.name), parent.name, False, Relation(MANY_TO_ONE, column, parent.name, other_column), nullable=bool(own and own.nullable))
            bridge = self._bridge(child, known)
            if bridge:
                child.is_through = True
            if not bridge or self.options.show_through:
                f = self._link(parent, lower_camel(plural(child.name)), child.name, True, Relation(ONE_TO_MANY, other_column, child.name, column))
                f.through = bool(bridge)
        for table in dict.fromkeys(fk[0] for fk in known):
            bridge = self._bridge(self.entity(table), known)
            if bridge:
                for (_, c1, t1, k1), (_, c2, t2, k2) in (bridge, bridge[::-1]):
                    a, b = self.entity(t1), self.entity(t2)
                    self._link(a, lower_camel(plural(b.name)), b.name, True, Relation(MANY_TO_MANY, k1, b.name, k2, Through(table, c1, c2)))
        for name, field_, relation in self.declared:
            e = self.entity(name)
            target = self.entity(relation.target)
            relation.target = target.name
            many = relation.kind in (ONE_TO_MANY, MANY_TO_MANY) or (relation.kind == RECURSIVE and not relation.up)
            if field_ in e.fields:
                del e.fields[field_]
            e.add(Field(field_, target.name, "", not many, list=many, relation=relation))

    def _link(self, e: Entity, name: str, target: str, many: bool, relation: Relation, nullable: bool = False) -> Field:
        for f in e.fields.values():
            if f.relation and f.relation == relation:
                return f
        what = f"{target} objects" if many else f"{target} object"
        return e.add(Field(self._free(e, name), target, "", nullable, list=many, relation=relation, description=f"related {what}"))

    @staticmethod
    def _bridge(e: Entity, known: list[tuple]) -> tuple | None:
        """The two foreign keys of a bridge: exactly two, which are the primary key or whose tables' names make the table's."""
        own = [fk for fk in known if fk[0] == e.table]
        if len(own) != 2 or own[0][2] == own[1][2]:
            return None
        (_, c1, t1, _), (_, c2, t2, _) = own
        return tuple(own) if set(e.primary_keys) == {c1, c2} or e.table in (f"{t1}_{t2}", f"{t2}_{t1}") else None

    # -- frames

    def bind(self, name: str, frame: DataFrame | Callable[[SparkSession], DataFrame]) -> Catalog:
        """The DataFrame (or a factory of it) behind a table or a virtual class."""
        self.frames[name] = frame if callable(frame) and not isinstance(frame, DataFrame) else (lambda _, f=frame: f)
        return self

    def frame(self, spark: SparkSession, e: Entity) -> DataFrame:
        for name in (e.table, e.name, e.resolver):
            if name and name in self.frames:
                return self.frames[name](spark)
        raise QueryError(f"entity {e.name} has no data behind it")

    def clone(self, name: str, base: Entity) -> Entity:
        e = copy.deepcopy(base)
        e.name = name
        return e
