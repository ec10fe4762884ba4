"""The schema as SDL text."""

from __future__ import annotations

from pathlib import Path

from nestq.plans.schema import SECTIONS, Member, Type, build
from nestq.sources.catalog import Catalog

WORDS = {"SCALAR": "scalar", "ENUM": "enum", "OBJECT": "type", "INPUT_OBJECT": "input"}


def _member(m: Member, kind: str, with_args: bool) -> list[str]:
    lines = [f"  # {m.description}"] if m.description else []
    if kind == "ENUM":
        return [*lines, f"  {m.name}"]
    if m.args and with_args:
        args = [f"{a.name}: {a.type}" for a in m.args]
        if len(args) <= 3:
            return [*lines, f"  {m.name}({', '.join(args)}): {m.type}"]
        return [*lines, f"  {m.name}(", *[f"    {a}" for a in args], f"  ): {m.type}"]
    return [*lines, f"  {m.name}: {m.type}"]


def _type(t: Type) -> str:
    head = [f"# {t.description}"] if t.description else []
    if t.kind == "SCALAR":
        return "\n".join([*head, f"scalar {t.name}"])
    roots = t.name in ("Query", "Mutation")
    body = [line for m in t.members for line in _member(m, t.kind, roots)]
    return "\n".join([*head, f"{WORDS[t.kind]} {t.name} {{", *body, "}"])


def render(catalog: Catalog, relation_args: bool = False) -> str:
    """All sections in order. Arguments of relation fields are written only on request."""
    types = build(catalog)
    parts = [f"# GraphQL schema\n# version: {catalog.version}"] if catalog.version else ["# GraphQL schema"]
    for s in SECTIONS:
        own = [t for t in types if t.section == s]
        if own:
            parts.append(f"# ------------------ {s} ------------------")
            parts += ["\n".join(_type(t) for t in own)] if s == "scalars" else [_type_with(t, relation_args) for t in own]
    return "\n\n".join(parts) + "\n"


def _type_with(t: Type, relation_args: bool) -> str:
    if not relation_args or t.kind != "OBJECT":
        return _type(t)
    head = [f"# {t.description}"] if t.description else []
    return "\n".join([*head, f"type {t.name} {{", *[line for m in t.members for line in _member(m, t.kind, True)], "}"])


def save(catalog: Catalog, path: str) -> None:
    Path(path).write_text(render(catalog))
