import pytest

from nestq.errors import QueryError
from nestq.plans.lang import EnumValue, bound_variables, fields_of, parse, pick_operation


def test_values_and_aliases():
    op = parse('query Q($a: Int = 3) { x: f(a: $a, b: [1, -2.5e1, "s\\n", true, null, RED], c: {k: {z: 1}}) { id } # end\n }').operations[0]
    f = fields_of(op.selection, parse("{a}"), bound_variables(op, {}))[0]
    assert (f.key, f.name) == ("x", "f")
    assert f.args == {"a": 3, "b": [1, -25.0, "s\n", True, None, EnumValue("RED")], "c": {"k": {"z": 1}}}


@pytest.mark.parametrize("text", ["", "{", "{ a(", "{ a(x: ) }", "{ }", "query {a", "{ a(x: 1, x: 2) }", "nope { a }", "{ a ... }", "{ a(x: 01) }"])
def test_syntax_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_operations():
    d = parse("query A { a } query B { b }")
    assert pick_operation(d, "B").name == "B"
    for name in (None, "C"):
        with pytest.raises(QueryError):
            pick_operation(d, name)


def test_required_variables():
    op = parse("query ($a: Int!) { a }").operations[0]
    for given in (None, {"a": None}):
        with pytest.raises(QueryError):
            bound_variables(op, given)


def test_fragments_and_directives():
    d = parse("query($t: Boolean = true) { ...F b @skip(if: $t) c @include(if: $t) ... on X { d } } fragment F on Q { a e { x } e { y } }")
    found = fields_of(d.operations[0].selection, d, {"t": True})
    assert [f.key for f in found] == ["a", "e", "c", "d"]
    assert [f.name for f in found[1].selection] == ["x", "y"]
    with pytest.raises(QueryError, match="conflict"):
        fields_of(parse("{ a: b a: c }").operations[0].selection, d, {})
    loop = parse("{ ...F } fragment F on Q { ...F }")
    with pytest.raises(QueryError, match="itself"):
        fields_of(loop.operations[0].selection, loop, {})
