from dataclasses import dataclass, field

import pytest

from lodestrata.plans import schema as S
from lodestrata.plans.paths import PathError, expand, leaves, type_of
from pyspark.sql import types as T

TEXT = """
Customer @PrimaryKey(id, name.value) { long id; Name name; ListOfOrder orders; Tags tags; Names names; } // the root
Name { string value; }
ListOfOrder List<Order>;   Order { long id; double price; }
Tags Set<Name> @HashKey(value);
Names Map<Name, Order> @HashKey(value);
"""


def test_parse_and_print_round_trip():
    s = S.parse(TEXT)
    assert S.parse(S.dump(s)) == s
    assert s["Names"].key_type == "Name" and s["Tags"].key == ("value",)
    assert S.schema_hash(s) == S.schema_hash(dict(reversed(list(s.items()))))


@pytest.mark.parametrize("bad", ["A { int }", "A List<B", "A {", "A { int x; } ; }", "A % {}"])
def test_parse_rejects(bad):
    with pytest.raises(S.SchemaError):
        S.parse(bad)


def test_order_and_reachability():
    s = S.parse(TEXT)
    order = S.dependency_order(s)
    assert order.index("Name") < order.index("Tags") < order.index("Customer")
    assert S.depends_on(s, "Customer", "Name") and not S.depends_on(s, "Name", "Order")
    assert S.top_level(s) == {"Customer"}
    with pytest.raises(S.SchemaError):
        S.dependency_order(S.parse("A { B b; } B { A a; }"))
    assert set(S.complete(S.parse("A { Missing m; } B { A a; } C { int x; }"))) == {"C"}


def test_common_and_union():
    a, b = S.parse("A @PrimaryKey(x) { int x; int y; }")["A"], S.parse("A @PrimaryKey(x) { int x; long z; }")["A"]
    assert [f for f, _ in a.common(b).fields] == ["x"] and a.common(b).key == ("x",)
    assert [f for f, _ in a.union(b).fields] == ["x", "y", "z"]
    with pytest.raises(S.SchemaError):
        a.common(S.parse("A { long x; }")["A"])


def test_dataclasses():
    @dataclass
    class Tag:
        name: str

    @dataclass
    class Item:
        __primary_key__ = ("id",)
        id: int
        tags: "set[str]" = field(default_factory=set)

    s = S.from_dataclass(Item)
    assert s["Item"].key == ("id",) and s["SetOfString"].kind == "set"
    assert S.spark_type(s, "Item").simpleString() == "struct<id:bigint,tags:array<string>>"


def test_paths():
    kind = S.spark_type(S.parse(TEXT), "Customer")
    assert isinstance(type_of(kind, "orders.element.price"), T.DoubleType)
    assert expand(kind, "name") == "name.value" and expand(kind, "name!") == "name"
    assert "names.key.value" in leaves(kind)
    for bad in ("orders.price", "id.x", "nope"):
        with pytest.raises(PathError):
            type_of(kind, bad)
    with pytest.raises(PathError):
        expand(kind, "orders")
