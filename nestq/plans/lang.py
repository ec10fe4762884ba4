"""GraphQL documents: a lexer and a recursive-descent parser into a small syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from nestq.errors import QueryError


class EnumValue(str):
    """A bare name used as a value."""


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass
class Directive:
    name: str
    args: dict[str, Any]


@dataclass
class Field:
    name: str
    alias: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    directives: list[Directive] = field(default_factory=list)
    selection: list[Any] = field(default_factory=list)

    @property
    def key(self) -> str:
        return self.alias or self.name


@dataclass
class Spread:
    """A named fragment, or an inline one (name None)."""

    name: str | None
    on: str | None = None
    directives: list[Directive] = field(default_factory=list)
    selection: list[Any] = field(default_factory=list)


@dataclass
class VariableDef:
    name: str
    type: str
    default: Any = None
    has_default: bool = False


@dataclass
class Operation:
    kind: str
    name: str | None
    variables: list[VariableDef]
    selection: list[Any]


@dataclass
class Document:
    operations: list[Operation]
    fragments: dict[str, Spread]


_TOKEN = re.compile(
    r"""(?P<skip>[\s,﻿]+|\#[^\n\r]*)
      |(?P<block>\"\"\"(?:\\\"\"\"|[^"]|"(?!""))*\"\"\")
      |(?P<string>"(?:\\.|[^"\\\n\r])*")
      |(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![A-Za-z_0-9.]))
      |(?P<name>[_A-Za-z][_0-9A-Za-z]*)
      |(?P<punct>\.\.\.|[!$&()\[\]{}:=@|])""",
    re.VERBOSE,
)
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"syntax error: unexpected {text[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    out.append(("end", "", at))
    return out


def _unquoted(token: str) -> str:
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), token[1:-1])


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.i = _tokens(text), 0

    def peek(self, value: str) -> bool:
        return self.tokens[self.i][1] == value and self.tokens[self.i][0] in ("punct", "name")

    def take(self, value: str) -> bool:
        if self.peek(value):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            _, found, at = self.tokens[self.i]
            raise QueryError(f"syntax error: expected {value!r}, found {found or 'the end'!r} at {at}")

    def name(self) -> str:
        kind, text, at = self.tokens[self.i]
        if kind != "name":
            raise QueryError(f"syntax error: expected a name, found {text or 'the end'!r} at {at}")
        self.i += 1
        return text

    def document(self) -> Document:
        operations, fragments = [], {}
        while self.tokens[self.i][0] != "end":
            if self.peek("fragment"):
                self.i += 1
                name = self.name()
                self.need("on")
                fragments[name] = Spread(name, self.name(), self.directives(), self.selection())
            elif self.peek("{"):
                operations.append(Operation("query", None, [], self.selection()))
            else:
                kind = self.name()
                if kind not in ("query", "mutation", "subscription"):
                    raise QueryError(f"syntax error: unexpected {kind!r}")
                name = self.name() if self.tokens[self.i][0] == "name" else None
                variables = self.variables() if self.take("(") else []
                self.directives()
                operations.append(Operation(kind, name, variables, self.selection()))
        return Document(operations, fragments)

    def variables(self) -> list[VariableDef]:
        out = []
        while not self.take(")"):
            self.need("$")
            name = self.name()
            self.need(":")
            kind = self.type()
            given = self.take("=")
            out.append(VariableDef(name, kind, self.value() if given else None, given))
            self.directives()
        return out

    def type(self) -> str:
        if self.take("["):
            inner = f"[{self.type()}"
            self.need("]")
            out = inner + "]"
        else:
            out = self.name()
        return out + "!" if self.take("!") else out

    def directives(self) -> list[Directive]:
        out = []
        while self.take("@"):
            name = self.name()
            out.append(Directive(name, self.arguments()))
        return out

    def arguments(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.take("("):
            while not self.take(")"):
                name = self.name()
                self.need(":")
                if name in out:
                    raise QueryError(f"argument {name} is given twice")
                out[name] = self.value()
        return out

    def selection(self) -> list[Any]:
        self.need("{")
        out: list[Any] = []
        while not self.take("}"):
            if self.take("..."):
                if self.peek("on") or self.peek("{") or self.peek("@"):
                    on = self.name() if self.take("on") else None
                    out.append(Spread(None, on, self.directives(), self.selection()))
                else:
                    out.append(Spread(self.name(), None, self.directives()))
                continue
            name, alias = self.name(), None
            if self.take(":"):
                name, alias = self.name(), name
            args, directives = self.arguments(), self.directives()
            out.append(Field(name, alias, args, directives, self.selection() if self.peek("{") else []))
        if not out:
            raise QueryError("syntax error: an empty selection")
        return out

    def value(self) -> Any:
        kind, text, at = self.tokens[self.i]
        if self.take("$"):
            return Variable(self.name())
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.value())
            return out
        if self.take("{"):
            obj: dict[str, Any] = {}
            while not self.take("}"):
                if self.tokens[self.i][0] == "string":  # JSON spelling of a key
                    key = _unquoted(self.tokens[self.i][1])
                    self.i += 1
                else:
                    key = self.name()
                self.need(":")
                obj[key] = self.value()
            return obj
        self.i += 1
        if kind == "number":
            return int(text) if re.fullmatch(r"-?[0-9]+", text) else float(text)
        if kind == "string":
            return _unquoted(text)
        if kind == "block":
            return text[3:-3].replace('\\"""', '"""').strip("\n")
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(text, EnumValue(text))
        raise QueryError(f"syntax error: unexpected {text or 'the end'!r} at {at}")


def parse(text: str) -> Document:
    """The document of a query text; raises QueryError on a syntax error."""
    found = _Parser(text).document()
    if not found.operations:
        raise QueryError("the document holds no operation")
    return found


def pick_operation(document: Document, name: str | None) -> Operation:
    """The only operation, or the one of that name."""
    if name:
        for op in document.operations:
            if op.name == name:
                return op
        raise QueryError(f"unknown operation {name!r}")
    if len(document.operations) > 1:
        raise QueryError("operationName is required: the document holds several operations")
    return document.operations[0]


def bound_variables(op: Operation, given: dict[str, Any] | None) -> dict[str, Any]:
    """Values of the operation's variables, defaults filled in."""
    given, out = given or {}, {}
    for v in op.variables:
        if v.name in given:
            out[v.name] = given[v.name]
        elif v.has_default:
            out[v.name] = v.default
        elif v.type.endswith("!"):
            raise QueryError(f"variable ${v.name} of type {v.type} is required")
        else:
            out[v.name] = None
        if out[v.name] is None and v.type.endswith("!"):
            raise QueryError(f"variable ${v.name} of type {v.type} must not be null")
    return out


def resolved(value: Any, variables: dict[str, Any]) -> Any:
    """``value`` with variables put in."""
    if isinstance(value, Variable):
        if value.name not in variables:
            raise QueryError(f"variable ${value.name} is not defined")
        return variables[value.name]
    if isinstance(value, list):
        return [resolved(v, variables) for v in value]
    if isinstance(value, dict):
        return {k: resolved(v, variables) for k, v in value.items()}
    return value


def fields_of(selection: list[Any], document: Document, variables: dict[str, Any], type_name: str | None = None, inside: tuple[str, ...] = ()) -> list[Field]:
    """Fields of a selection: fragments expanded, @skip and @include applied, equal response keys merged, variables put in."""
    out: dict[str, Field] = {}
    for item in selection:
        if not _wanted(item.directives, variables):
            continue
        if isinstance(item, Spread):
            spread = item
            if item.name is not None:
                if item.name in inside:
                    raise QueryError(f"fragment {item.name} spreads itself")
                if item.name not in document.fragments:
                    raise QueryError(f"unknown fragment {item.name}")
                spread = document.fragments[item.name]
                if not _wanted(spread.directives, variables):
                    continue
            if type_name and spread.on and spread.on != type_name:
                continue
            nested = (*inside, item.name) if item.name else inside
            found = fields_of(spread.selection, document, variables, type_name, nested)
        else:
            found = [Field(item.name, item.alias, resolved(item.args, variables), [], item.selection)]
        for f in found:
            if f.key in out:
                other = out[f.key]
                if other.name != f.name or other.args != f.args:
                    raise QueryError(f"fields under the response key {f.key} conflict")
                out[f.key] = Field(f.name, f.alias, f.args, [], other.selection + f.selection)
            else:
                out[f.key] = f
    return list(out.values())


def _wanted(directives: list[Directive], variables: dict[str, Any]) -> bool:
    for d in directives:
        if d.name in ("skip", "include"):
            given = resolved(d.args, variables).get("if")
            if not isinstance(given, bool):
                raise QueryError(f"@{d.name} needs a boolean argument if")
            if given == (d.name == "skip"):
                return False
    return True
