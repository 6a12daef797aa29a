import random

import pytest
from pyspark.sql import functions as F

from witspark.operators import contract as C, ingest as G, observe as O
from witspark.operators.project import causal_closure, causal_depth, evidence_columns


def brute_match(expect, records, checks):
    wide = [r for r in records if r["url"] == expect["url"]]
    exact = [r for r in wide if all(expect[c] is None or r[c] == expect[c] for c in checks)]
    if len(exact) == 1:
        return "observed", None
    if len(exact) > 1:
        return "unverified", None
    if wide:
        first = min(wide, key=lambda r: r["ordinal"])
        wrong = [c for c in checks if expect[c] is not None and first[c] != expect[c]]
        return "conflicting", ",".join(wrong)
    return "unverified", None


def test_matching_equals_brute_force(spark):
    rng = random.Random(4)
    urls = ["hot"] * 4 + ["a", "b", "c"]
    records = [
        {"url": rng.choice(urls), "body_digest": rng.choice(["x", "y", None]), "etag": rng.choice(["1", "2", None]), "status_code": rng.choice([200, 404]), "ordinal": i}
        for i in range(60)
    ]
    expect = [
        {"id": i, "url": rng.choice(urls + ["none"]), "body_digest": rng.choice(["x", "z", None]), "etag": rng.choice(["1", None]), "status_code": rng.choice([200, None])}
        for i in range(80)
    ]
    x = spark.createDataFrame(expect, "id int, url string, body_digest string, etag string, status_code int")
    r = spark.createDataFrame(records, "url string, body_digest string, etag string, status_code int, ordinal int")
    got = {row["id"]: (row["outcome"], row["conflicts"]) for row in O.match_responses(x, r).collect()}
    assert got == {e["id"]: brute_match(e, records, ["body_digest", "etag", "status_code"]) for e in expect}


def events(spark, rows):
    df = spark.createDataFrame(
        [(f"e{i}", "s", run, kind, second * 1_000_000) for i, (run, kind, second) in enumerate(rows)],
        "event_id string, scope string, run_id string, event_type string, us bigint",
    )
    return df.withColumn("occurred_at", F.timestamp_micros("us"))


@pytest.mark.parametrize("split", [False, True])
def test_latency_takes_the_nearest_start_on_either_side(spark, split):
    rng = random.Random(9)
    rows = [(rng.choice(["big", "big", "r"]), rng.choice(["start", "end", "other"]), rng.randint(0, 400)) for _ in range(120)]
    want = set()
    for i, (run, kind, second) in enumerate(rows):
        starts = [t for r, k, t in rows if r == run and k == "start"]
        if kind == "end" and min(abs(second - t) for t in starts) > 10:
            want.add(f"e{i}")
    if split:
        spark.conf.set("witspark.hotRows", "5")
    try:
        found = C.check_latency(events(spark, rows), C.Latency("start", "end", 10.0), ["scope"])
        got = {r["event_id"] for r in found.filter("code = 'latency_breach'").collect()}
    finally:
        spark.conf.unset("witspark.hotRows")
    assert got == want and want


def test_link_wins_entirely_in_flavour_a_only(spark):
    rows = [
        ("both_null", '{"verification_status":"observed","evidence_link":{"verification_status":null}}'),
        ("empty", '{"verification_status":""}'),
        ("plain", '{"verification_status":"verified","subject_event_id":"s"}'),
        ("not_object", '{"verification_status":"verified","evidence_link":"text"}'),
    ]
    df = spark.createDataFrame(rows, "event_id string, payload string").withColumn("payload_v", F.try_parse_json("payload"))

    def statuses(flavour):
        found = evidence_columns(df, flavour).collect()
        return {r["event_id"]: (r["verification_status"], r["evidence_subject_event_id"]) for r in found}

    assert statuses("a") == {"both_null": (None, None), "empty": (None, None), "plain": ("verified", "s"), "not_object": ("verified", None)}
    assert statuses("b") == {"both_null": ("observed", None), "empty": (None, None), "plain": ("verified", None), "not_object": ("verified", None)}


def test_causal_walks(spark):
    rows = [(f"e{i}", f"e{i - 1}" if i else None) for i in range(40)] + [("x", "gone"), ("c1", "c2"), ("c2", "c1")]
    df = spark.createDataFrame(rows, "event_id string, parent_event_id string")
    found = {r["event_id"]: (r["root"], r["depth"]) for r in causal_depth(df).collect()}
    assert found["e39"] == ("e0", 39) and found["e0"] == ("e0", 0) and found["x"] == ("x", 0)
    assert found["c1"] == (None, None)
    seeds = df.filter("event_id = 'e3'").select("event_id")
    up = {(r["event_id"], r["depth"]) for r in causal_closure(df, seeds).collect()}
    assert up == {("e2", 1), ("e1", 2), ("e0", 3)}
    down = causal_closure(df, seeds, "descendants").collect()
    assert {(r["event_id"], r["depth"]) for r in down} == {(f"e{3 + i}", i) for i in range(1, 37)}
    # A cycle ends; what it reaches has its least depth.
    around = causal_closure(df, df.filter("event_id = 'c1'").select("event_id")).collect()
    assert [(r["event_id"], r["depth"]) for r in around] == [("c2", 1)]


def test_long_chains_are_followed_to_their_end(spark):
    df = spark.createDataFrame(
        [(f"e{i}", f"e{i - 1}" if i else None) for i in range(100)], "event_id string, parent_event_id string"
    )
    found = causal_closure(df, df.filter("event_id = 'e99'").select("event_id"))
    assert found.count() == 99 and found.agg({"depth": "max"}).first()[0] == 99


def test_failed_record_does_not_claim_its_key(spark):
    rows = [("k", "s", 1, "f1", "e1", False), ("k", "s", 2, "f1", "e2", True), ("k", "s", 3, "f2", "e3", True), ("k", "s", 4, "f1", "e4", False)]
    df = spark.createDataFrame(rows, "idempotency_key string, sort_key string, arrival int, fingerprint string, event_id string, valid boolean")
    old = spark.createDataFrame([], "idempotency_key string, event_id string, fingerprint string, position int")
    got = [(r["status"], r["event_id"]) for r in G.import_batch(df, old).orderBy("arrival").collect()]
    assert got == [("failed", None), ("imported", "e2"), ("conflict", "e2"), ("duplicate", "e2")]


def test_contract_loading():
    data = {
        "metadata": {"name": "c"},
        "spec": {"requirements": {"events": [{"type": "a", "requiredFields": ["payload.x"]}], "verification": {"allowedStatuses": ["verified"]}}},
    }
    found = C.contract_from_dict(data)
    assert found.name == "c" and found.events[0].fields == ("payload.x",) and found.allowed_statuses == ("verified",)
