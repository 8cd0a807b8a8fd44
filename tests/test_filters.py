import json

import pytest
from pyspark.sql import functions as F

from pointloom import ids
from pointloom.errors import InvalidFilterError, InvalidPointError
from pointloom.operators.filters import Filter, HasId, Match, Range, compile_filter, matches_filter

PAYLOADS = [
    {"kind": "lamp", "price": 12.0, "tags": ["brass", "wall"]},
    {"kind": "chair", "price": 7, "tags": []},
    {"trips": [{"port": "oslo", "days": 4}, {"port": "riga", "days": 5}]},
    {"kind": None}, {"kind": True}, {"kind": 1}, {"kind": 1.0}, {"kind": "1"}, {"kind": [[1, [2]], 3]}, {"kind": {"deep": 5}},
    {}, {"price": True}, {"price": "12"}, {"price": [1, 30]}, {"kind": 2**53 + 1}, {"kind": 2**53}, {"kind": [[[[[[1]]]]], [[[[{"deep": [[[[5]]]]}]]]]]}, {"price": [[[[[[30.5]]]]]]},
]
CONDITIONS = [
    Match("kind", "lamp"), Match("kind", None), Match("kind", 1), Match("kind", True), Match("kind", "1"), Match("tags", "wall"), Match("kind", 2),
    Match("kind", 3), Match("kind.deep", 5), Match("kind", 2**53 + 1), Range("price", gte=7, lt=12.5), Range("price", gt=12), Range("kind", lte=1),
    Filter(), Filter(must=[Match("trips.port", "oslo"), Range("trips.days", gte=5)]), Filter(must_not=[Match("kind", "lamp")]),
    Filter(should=[Match("kind", "chair"), Range("price", gt=11)]), Filter(must=[Filter(must_not=[Match("kind", None)])], should=[HasId([0, 4, 5])]),
    HasId([1, 3]), Range("kind", gt=2**53), Range("kind", lte=2**53), Range("kind", gt=float(2**53)), Range("kind", gte=0.5, lt=1.5), Range("kind", lt=-(2.0**200)), Filter(must_not=[Match("no.such", 1)]),
]


def test_compiled_filters_agree_with_python(spark):
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(PAYLOADS)], "id long, json string").withColumn("p", F.parse_json("json"))
    found = rows.select("id", *(compile_filter(c, F.col("p"), ids.key_of_integers(F.col("id"))).alias(f"c{k}") for k, c in enumerate(CONDITIONS))).collect()
    for row in found:
        for k, c in enumerate(CONDITIONS):
            assert row[f"c{k}"] == matches_filter(c, row["id"], PAYLOADS[row["id"]]), (c, PAYLOADS[row["id"]])


@pytest.mark.parametrize(
    "make",
    [lambda: Match("", 1), lambda: Match("bad..path", 1), lambda: Match("a", float("nan")), lambda: Match("a", [1]), lambda: Range("a"), lambda: Range("a", gt=float("nan")),
     lambda: Range("a", gt=2, lte=1), lambda: Range("a", gt=1, gte=1), lambda: Range("a", gt=True), lambda: HasId([]), lambda: HasId([-1]), lambda: Filter(must=[1])],
)
def test_invalid_conditions(make):
    with pytest.raises(InvalidFilterError):
        make()


def test_ids():
    assert ids.canonical("{12345678-1234-5678-1234-567812345678}") == "12345678-1234-5678-1234-567812345678"
    assert sorted([ids.key("ffffffff-1234-5678-1234-567812345678"), ids.key(2**64 - 1), ids.key(9)])[0] == ids.key(9)
    assert ids.from_key(ids.key(42)) == 42
    for bad in (-1, 2**64, "", "not-a-uuid", True, 1.5, None):
        with pytest.raises(InvalidPointError):
            ids.canonical(bad)
