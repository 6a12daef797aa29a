"""The JSON walk: wanted columns only, and sizes of a text in one row."""

import pytest

from witspark.functions.jsonwalk import json_sizes, walk_json
from witspark.operators import project, validate
from witspark.plans import projection

TEXTS = [
    (1, '{"a":{"b":[1,2,3]},"c":"x"}'),
    (1, '{"c":"x"}'),
    (2, None),
    (3, "{"),
    (3, "[]"),
    (4, '"x"'),
    (None, '{"marker":"witspark.capture.v1","name":"h","digest":"d","a":1,"b":[[]]}'),
    (5, '{"a":1,"a":2}'),
    (6, "[[[[1]]],{}]"),
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id bigint, payload string")


def by_nodes(rows):
    known = [r for r in rows if r["kind"] != "invalid"]

    def most(kind):
        return max((r["members"] for r in known if r["kind"] == kind), default=0)

    return max(r["depth"] for r in rows), most("object"), most("array"), len(known) == len(rows)


def test_sizes_are_those_of_the_nodes(texts):
    nodes = walk_json(texts, ["id"], "payload").collect()
    found = {r["id"]: tuple(r)[1:4] for r in validate.json_limits(texts, ["id"]).collect()}
    expected = {i: by_nodes([r for r in nodes if r["id"] == i])[:3] for i in {r["id"] for r in nodes}}
    assert found == expected and 2 not in found
    assert sum(r["parsed"] for r in json_sizes(texts, ["id"], "payload").collect()) == 6


def test_a_text_sends_one_row(texts):
    assert json_sizes(texts, ["id"], "payload").count() == sum(t is not None for _, t in TEXTS)
    plan = validate.json_limits(texts, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "members" not in plan.replace("max_members", "")


def test_wanted_columns_are_those_of_the_whole_walk(texts):
    whole = walk_json(texts, ["id"], "payload", kinds=("string",))
    some = walk_json(texts, ["id"], "payload", kinds=("string",), fields=("key", "text"))
    assert some.columns == ["id", "key", "text"]
    assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select("id", "key", "text").collect()))
    values = project.string_values(texts, ["id"], "payload")._jdf.queryExecution().optimizedPlan().toString()
    assert "inside_capture" not in values


def test_closures_build_no_payloads(spark):
    written = []
    real = projection.causal_events
    projection.causal_events = lambda *a: written.append(real(*a)) or written[-1]
    try:
        projection.causal_ancestors(spark, "/root/testdata/sf0.001")
    finally:
        projection.causal_events = real
    assert written and "payload" not in written[0].columns
