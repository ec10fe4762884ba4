"""``__schema`` and ``__type``."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from nestq.errors import QueryError
from nestq.plans.lang import Field
from nestq.plans.schema import BUILT_IN, Arg, Member, Type, build
from nestq.sources.catalog import Catalog

#: Where the two directives may stand. Fixed values.
LOCATIONS = ["FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"]


def type_ref(text: str, kinds: dict[str, str]) -> dict[str, Any]:
    if text.endswith("!"):
        return {"kind": "NON_NULL", "name": None, "ofType": type_ref(text[:-1], kinds)}
    if text.startswith("["):
        return {"kind": "LIST", "name": None, "ofType": type_ref(text[1:-1], kinds)}
    return {"kind": kinds.get(text, "SCALAR"), "name": text, "ofType": None}


def _arg(a: Arg | Member, kinds: dict[str, str]) -> dict[str, Any]:
    return {"name": a.name, "description": a.description or None, "type": type_ref(a.type, kinds), "defaultValue": getattr(a, "default", None), "isDeprecated": False, "deprecationReason": None}


def described(t: Type, kinds: dict[str, str]) -> dict[str, Any]:
    """A full type; what its kind does not have is null."""
    never = {"isDeprecated": False, "deprecationReason": None}
    fields = [{"name": m.name, "description": m.description or None, "args": [_arg(a, kinds) for a in m.args], "type": type_ref(m.type, kinds), **never} for m in t.members]
    return {
        "kind": t.kind,
        "name": t.name,
        "description": t.description or None,
        "fields": fields if t.kind == "OBJECT" else None,
        "inputFields": [_arg(m, kinds) for m in t.members] if t.kind == "INPUT_OBJECT" else None,
        "interfaces": [] if t.kind == "OBJECT" else None,
        "enumValues": [{"name": m.name, "description": m.description or None, **never} for m in t.members] if t.kind == "ENUM" else None,
        "possibleTypes": None,
        "specifiedByURL": None,
        "ofType": None,
    }


def schema(catalog: Catalog) -> dict[str, Any]:
    types = [Type("SCALAR", n) for n in sorted(BUILT_IN)] + build(catalog)
    kinds = {t.name: t.kind for t in types}
    condition = {"name": "if", "description": None, "type": type_ref("Boolean!", kinds), "defaultValue": None, "isDeprecated": False, "deprecationReason": None}
    return {
        "description": None,
        "queryType": {"name": "Query", "kind": "OBJECT"},
        "mutationType": {"name": "Mutation", "kind": "OBJECT"} if "Mutation" in kinds else None,
        "subscriptionType": None,
        "types": [described(t, kinds) for t in types],
        "directives": [{"name": n, "description": None, "locations": LOCATIONS, "args": [condition], "isRepeatable": False} for n in ("include", "skip")],
    }


def _selected(value: Any, selection: list[Any], fields: Callable[[list[Any]], list[Field]]) -> Any:
    if isinstance(value, list):
        return [_selected(v, selection, fields) for v in value]
    if not isinstance(value, dict) or not selection:
        return value
    out = {}
    for f in fields(selection):
        if f.name == "__typename":
            out[f.key] = "__Type" if "kind" in value else "__Schema" if "types" in value else "__Field"
        elif f.name in value:
            out[f.key] = _selected(value[f.name], f.selection, fields)
        elif "kind" in value and "ofType" in value:
            out[f.key] = None
        else:
            raise QueryError(f"unknown introspection field {f.name}")
    return out


def introspect(catalog: Catalog, f: Field, fields: Callable[[list[Any]], list[Field]], variables: dict[str, Any]) -> Any:
    """The answer to one introspection field. The name of ``__type`` is its argument or, without one, the variable ``name``."""
    whole = schema(catalog)
    if f.name == "__schema":
        return _selected(whole, f.selection, fields)
    name = f.args.get("name", variables.get("name"))
    if not name:
        raise QueryError("__type needs a name")
    found = next((t for t in whole["types"] if t["name"] == name), None)
    return _selected(found, f.selection, fields) if found else None
