"""Reachability over parent links against a level-by-level walk."""

import random

import pytest
from pyspark.sql import functions as F

from witspark.operators import project
from witspark.plans.lineage import Rounds


def walk(edges, seeds, direction):
    known = {e for e, _ in edges}
    near = {}
    for event, parent in edges:
        if parent in known:
            a, b = (event, parent) if direction == "ancestors" else (parent, event)
            near.setdefault(a, set()).add(b)
    out = set()
    for seed in seeds:
        depth, seen, front = 0, {seed}, {seed}
        while front:
            depth += 1
            front = {b for a in front for b in near.get(a, ())} - seen
            seen |= front
            out |= {(seed, e, depth) for e in front}
    return out


def closure(spark, edges, seeds, direction):
    df = spark.createDataFrame(edges, "event_id string, parent_event_id string")
    rows = spark.createDataFrame([(s,) for s in seeds], "event_id string")
    got = [tuple(r) for r in project.causal_closure(df, rows, direction).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("direction", ["ancestors", "descendants"])
@pytest.mark.parametrize("kind", ["forest", "cycles", "repeated ids"])
def test_equals_a_walk(spark, direction, kind):
    r = random.Random(kind)
    edges = []
    for i in range(60):
        parent = r.choice([None, f"e{r.randrange(i)}", f"e{r.randrange(i)}", "unknown"]) if i else None
        if kind == "cycles" and r.random() < 0.2:
            parent = f"e{r.randrange(60)}"
        edges.append((f"e{i}", parent))
        if kind == "repeated ids" and r.random() < 0.2:
            edges.append((f"e{i}", f"e{r.randrange(60)}"))
    edges.append(("own", "own"))
    seeds = [f"e{i}" for i in range(0, 60, 3)] + ["own", "missing", "e0"]
    assert closure(spark, edges, seeds, direction) == walk(edges, seeds, direction)


def test_empty(spark):
    for direction in ("ancestors", "descendants"):
        assert closure(spark, [], ["e"], direction) == set()
        assert closure(spark, [("e", None)], [], direction) == set()


@pytest.mark.parametrize("direction, seed", [("ancestors", "e2999"), ("descendants", "e0")])
def test_a_long_chain_takes_few_rounds(spark, direction, seed, monkeypatch):
    taken = []
    add = Rounds.add
    monkeypatch.setattr(Rounds, "add", lambda self, *a: (taken.append(1), add(self, *a))[1])
    df = spark.range(3000).select(
        F.concat(F.lit("e"), "id").alias("event_id"),
        F.when(F.col("id") > 0, F.concat(F.lit("e"), F.col("id") - 1)).alias("parent_event_id"),
    )
    found = project.causal_closure(df, spark.createDataFrame([(seed,)], "event_id string"), direction)
    assert found.count() == 2999 and found.agg(F.max("depth")).first()[0] == 2999
    assert len(taken) <= 14  # the seeds, twelve doublings and one round without anything new
