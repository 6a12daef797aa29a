import random

import pytest
from pyspark.sql import Window as W, functions as F

from witspark.operators.ordered import in_order

WANTED = {
    "rn": ("row_number", None),
    "before": ("lag", "v"),
    "after": ("lead", "v"),
    "first": ("first", "v"),
    "down": ("carry_forward", "v"),
    "up": ("carry_back", "v"),
}


def rows(seed, n=300):
    rng = random.Random(seed)
    return [
        (rng.choice(["big", "big", "big", "a", "b", None]), i, rng.choice([None, f"v{i}", f"v{i}"]))
        for i in range(n)
    ]


def collect(df):
    return sorted(map(tuple, df.select("g", "i", "v", *WANTED).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_plan_equals_windows(spark, seed):
    df = spark.createDataFrame(rows(seed), "g string, i int, v string").repartition(5)
    plain = collect(in_order(df, ["g"], ["i"], WANTED))
    spark.conf.set("witspark.hotRows", "10")
    try:
        split = collect(in_order(df, ["g"], ["i"], WANTED))
    finally:
        spark.conf.unset("witspark.hotRows")
    assert split == plain


def test_equal_times_are_split_by_the_rest_of_the_order(spark, hot):
    data = [("g", 5, i, f"v{i}") for i in range(100)]
    df = spark.createDataFrame(data, "g string, t int, i int, v string")
    found = in_order(df, ["g"], ["t", "i"], {"rn": ("row_number", None), "before": ("lag", "v")})
    assert [(r["rn"], r["before"]) for r in found.orderBy("i").collect()] == [
        (i + 1, f"v{i - 1}" if i else None) for i in range(100)
    ]


def test_hot_group_spans_several_tasks(spark, hot):
    df = spark.createDataFrame([("g", i) for i in range(400)], "g string, i int")
    found = in_order(df, ["g"], ["i"], {"rn": ("row_number", None)})
    text = found._jdf.queryExecution().toString()
    assert "__piece" in text
    assert found.agg(F.max("rn")).first()[0] == 400
