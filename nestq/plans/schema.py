"""The GraphQL schema of a catalog, as a list of types; text and introspection are made of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from nestq.operators.predicates import KEYS, NUMERIC, OPERATORS
from nestq.operators.stats import BY_KIND, stats_kind
from nestq.sources.catalog import Catalog, Entity, Field
from nestq.sources.naming import lower_camel, plural

SECTIONS = ("scalars", "enums", "common", "types", "paging", "stats", "filters", "entity filters", "sort", "input", "query", "mutation")
BUILT_IN = {"ID", "Int", "Float", "String", "Boolean"}
#: Fields that update inputs leave out. Fixed values.
STAMPS = {"id", "createdAt", "updatedAt"}
#: Operators that the schema declares for a scalar where they are fewer than the engine understands. Fixed values.
DECLARED = {"ID": ("eq", "in", "gt", "ge", "lt", "le"), "Boolean": ("eq", "in"), "Json": ("is", "eq", "in", *KEYS)} | {s: tuple(op for op in NUMERIC if op != "ni") for s in ("Int", "Float", "DateTime", "Date")}
#: What the operators mean. Fixed values.
MEANING = {
    "is": "is null or not", "eq": "equal", "ne": "not equal", "in": "one of", "ni": "none of", "gt": "greater", "ge": "greater or equal", "lt": "less", "le": "less or equal",
    "like": "like a pattern", "iLike": "like a pattern, without case", "regex": "matches a regular expression", "iRegex": "matches a regular expression, without case",
    "hasKey": "has the key", "hasKeyAny": "has any of the keys", "hasKeyAll": "has all keys",
}


@dataclass
class Arg:
    name: str
    type: str
    description: str = ""
    default: str | None = None


@dataclass
class Member:
    name: str
    type: str
    description: str = ""
    args: list[Arg] = field(default_factory=list)


@dataclass
class Type:
    kind: str  # SCALAR, ENUM, OBJECT, INPUT_OBJECT
    name: str
    members: list[Member] = field(default_factory=list)
    description: str = ""
    section: str = ""


def field_type(f: Field) -> str:
    if f.relation:
        return f"[{f.type}]!" if f.list else f.type + ("" if f.nullable else "!")
    kind = "ID" if f.primary else f.type
    return kind if f.nullable and not f.primary else kind + "!"


def filter_type(f: Field) -> str:
    return f"{'ID' if f.primary else f.type}WhereInput"


def list_args(e: Entity) -> list[Arg]:
    n = e.name
    kinds = [("id", "ID"), ("where", f"{n}WhereInput"), ("sort", f"[{n}SortInput!]"), ("limit", "Int"), ("offset", "Int"), ("first", "Int"), ("last", "Int"), ("after", "Cursor"), ("before", "Cursor")]
    return [Arg(a, t) for a, t in kinds]


def _stats_fields(e: Entity) -> list[tuple[Field, str]]:
    return [(f, k) for f in sorted(e.columns, key=lambda f: f.name) if (k := stats_kind(f))]


def build(catalog: Catalog) -> list[Type]:
    """All types, in the order of SECTIONS; entities and fields by name."""
    out: list[Type] = []

    def put(section: str, kind: str, name: str, members=(), description: str = "") -> None:
        out.append(Type(kind, name, [m if isinstance(m, Member) else Member(*m) for m in members], description, section))

    entities = [catalog.entities[n] for n in sorted(catalog.entities)]
    shown = [e for e in entities if catalog.options.show_through or not e.is_through]
    for s in ("Json", "Cursor", "DateTime"):
        put("scalars", "SCALAR", s)
    if any(f.type == "Date" for e in entities for f in e.columns):
        put("scalars", "SCALAR", "Date")
    directions = ("ASC", "DESC", "ASC_NULLS_FIRST", "DESC_NULLS_FIRST", "ASC_NULLS_LAST", "DESC_NULLS_LAST")
    put("enums", "ENUM", "SortDirection", [(d, "") for d in directions], "Direction of a sort, and where nulls go")
    put("enums", "ENUM", "IsInput", [("NULL", ""), ("NOT_NULL", "")], "Condition on null")
    put("common", "OBJECT", "PageInfo", [("hasNext", "Boolean!"), ("hasPrev", "Boolean!"), ("start", "Cursor"), ("end", "Cursor")], "Page of a cursor")
    put("common", "INPUT_OBJECT", "GroupBy", [("fields", "[String!]"), ("having", "Json"), ("limit", "Int"), ("sort", "Json")], "Options of grouping")

    for e in shown:
        members = []
        for f in sorted(e.fields.values(), key=lambda f: f.name):
            if f.through and not catalog.options.show_through:
                continue
            args = list_args(catalog.entity(f.relation.target)) if f.relation and f.list else []
            if f.relation and f.relation.kind == "Recursive":
                args = [*args, Arg("level", "Int")]
            members.append(Member(f.name, field_type(f), f.description, args))
        put("types", "OBJECT", e.name, members, e.description)
    for e in shown:
        put("paging", "OBJECT", f"{e.name}Result", [("items", f"[{e.name}!]!"), ("total", "Int!"), ("pageInfo", "PageInfo!")], f"Page of {e.name}")

    kinds = {"NumberStats": "Float", "DateTimeStats": "DateTime", "StringStats": "String"}
    for name, value in kinds.items():
        put("stats", "OBJECT", name, [(a, "Int!" if a.startswith("count") else value) for a in BY_KIND[name]], f"Aggregates of {value} values")
    for e in shown:
        members = [("count", "Int!"), *[(f.name, k) for f, k in _stats_fields(e)], ("groupBy", f"[{e.name}Group!]", "Groups")]
        put("stats", "OBJECT", f"{e.name}Stats", members, f"Aggregates of {e.name}")
        group = [("key", "Json!"), ("count", "Int!"), *[(f.name, k) for f, k in _stats_fields(e)]]
        put("stats", "OBJECT", f"{e.name}Group", group, f"Group of {e.name}")

    used = {filter_type(f).removesuffix("WhereInput") for e in shown for f in e.columns if f.column}
    for scalar in sorted(used | {"Boolean", "DateTime", "Float", "ID", "Int", "Json", "String"}):
        members = []
        for op in DECLARED.get(scalar, OPERATORS["String"]):
            if op in ("ilike", "ni"):
                continue
            kind = "IsInput" if op == "is" else f"[{scalar}!]" if op in ("in", "ni") else "[String!]" if op in ("hasKeyAny", "hasKeyAll") else "String" if op in ("like", "iLike", "regex", "iRegex", "hasKey") else scalar
            members.append((op, kind, MEANING[op]))
        put("filters", "INPUT_OBJECT", f"{scalar}WhereInput", members, f"Conditions on {scalar}")
    for e in shown:
        own = [(f.name, filter_type(f)) for f in sorted(e.columns, key=lambda f: f.name) if f.column]
        name = f"{e.name}WhereInput"
        put("entity filters", "INPUT_OBJECT", name, [*own, ("and", f"[{name}!]"), ("or", f"[{name}!]"), ("not", name)], f"Conditions on {e.name}")
    for e in shown:
        put("sort", "INPUT_OBJECT", f"{e.name}SortInput", [(f.name, "SortDirection") for f in sorted(e.columns, key=lambda f: f.name) if f.column], f"Sort of {e.name}")
    changed = [e for e in shown if not e.virtual]
    for e in changed:
        columns = [f for f in sorted(e.columns, key=lambda f: f.name) if f.column and not f.virtual]
        put("input", "INPUT_OBJECT", f"{e.name}CreateInput", [(f.name, field_type(f)) for f in columns], f"New {e.name}")
        update = [(f.name, field_type(f).rstrip("!")) for f in columns if f.name not in STAMPS]
        put("input", "INPUT_OBJECT", f"{e.name}UpdateInput", [*update, ("relation", "RelationInput")], f"Change of {e.name}")
    put("input", "INPUT_OBJECT", "RelationInput", [("id", "ID!"), ("connect", "[ID!]"), ("disconnect", "[ID!]")], "Change of a relation")

    queries = []
    for e in shown:
        queries.append(Member(lower_camel(plural(e.name)), f"{e.name}Result!", f"{e.name} query", list_args(e)))
        queries.append(Member(f"{lower_camel(e.name)}Stats", f"{e.name}Stats!", f"{e.name} statistics", [Arg("where", f"{e.name}WhereInput"), Arg("groupBy", "GroupBy")]))
    put("query", "OBJECT", "Query", queries)
    mutations = []
    for e in changed:
        where = [Arg("id", "ID"), Arg("where", f"{e.name}WhereInput")]
        mutations.append(Member(f"create{e.name}", f"{e.name}!", f"Create {e.name}", [Arg("input", f"{e.name}CreateInput!")]))
        mutations.append(Member(f"update{e.name}", f"{e.name}!", f"Update {e.name}", [Arg("input", f"{e.name}UpdateInput!"), *where]))
        mutations.append(Member(f"delete{e.name}", "Int!", f"Delete {e.name}", where))
    put("mutation", "OBJECT", "Mutation", mutations)
    return [t for t in out if t.members or t.kind == "SCALAR"]
