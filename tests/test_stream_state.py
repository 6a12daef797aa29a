"""Stateful streams: unordered rules, repeats, suppression and state that expires."""

import random
import time

import pytest
from pyspark.sql import functions as F

from witspark.functions.payload import Resolver
from witspark.operators import detect
from witspark.operators.rules import Rule, Stage
from witspark.streaming import ops

SECOND = 1_000_000
#: Times of the rows begin here: nothing may lie at or before the first watermark, 1970.
START = 1_000_000 * SECOND
EVENTS = "event_id string, event_type string, occurred_at timestamp, sequence bigint, grp string, sub string, payload string"
RESOLVER = Resolver("payload_v", {"g": "grp", "s": "sub"})


def frame(spark, rows):
    """(id, type, second, group, suppression) as events."""

    df = spark.createDataFrame(
        [(i, t, START + int(at * SECOND), n, g, s, "{}") for n, (i, t, at, g, s) in enumerate(rows)],
        EVENTS.replace("occurred_at timestamp", "us bigint"),
    )
    return df.select("event_id", "event_type", F.timestamp_micros("us").alias("occurred_at"), "sequence", "grp", "sub", "payload")


def played(spark, folder, batches, build, schema=None):
    """The stream that `build` makes of the batches, one micro-batch each, and its query."""

    ops.use_rocksdb(spark)
    first = None
    for batch in batches:
        first = batch if first is None else first
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken by their time, which has whole seconds
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = build(stream)
    query = (
        out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        .option("path", f"{folder}/out").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect(), query


def end(at=100_000):
    return [("end", "a", at, "end", "")]


def matches(spark, folder, batches, rules, horizon=None):
    frames = [frame(spark, b) for b in [*batches, end()]]

    def build(stream):
        events = stream.withColumn("payload_v", F.try_parse_json("payload"))
        return ops.stream_sequences(events, rules, "1000 seconds", RESOLVER, horizon)

    rows, query = played(spark, folder, frames, build)
    found = sorted((r["rule_no"], r["group_key"], tuple(r["event_ids"])) for r in rows if "end" not in r["group_key"])
    return found, query


def in_batch(spark, rows, rules):
    events = frame(spark, rows).withColumn("payload_v", F.try_parse_json("payload"))
    names = {r.rule_id: n for n, r in enumerate(rules)}
    found = detect.evaluate_rules(events, rules, resolver=RESOLVER)
    shown = found.select("rule_id", F.to_json("group_key").alias("g"), "event_ids").collect()
    return sorted((names[r["rule_id"]], r["g"], tuple(r["event_ids"])) for r in shown)


def rule(name, types, **options):
    return Rule(name, name, tuple(Stage(t) for t in types), group_by=("g",), **options)


RULES = [
    rule("any", "bab", ordered=False),
    rule("tight", "ab", ordered=False, within_seconds=20.0),
    rule("single", "c", ordered=False),
    rule("steps", "ab"),
    rule("quiet", "ab", suppression_seconds=60.0, suppression_key=("s",)),
    rule("all", "ab", deduplicate=False),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_with_late_and_disordered_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(f"e{n}", r.choice("abc"), r.randrange(900), r.choice("xyz"), r.choice("st")) for n in range(80)]
    rows += [("x", "b", 5, "few", "s"), ("y", "a", 3, "few", "s")]
    rows = [(i, t, at + k / 100, g, s) for k, (i, t, at, g, s) in enumerate(rows)]
    # All rows lie within the delay, so whatever order they come in, none is too late.
    batches = [rows[0::3], rows[1::3], rows[2::3]]
    found, _ = matches(spark, tmp_path, batches, RULES)
    assert found == in_batch(spark, rows, RULES)


def test_repeated_events_match_once(spark, tmp_path):
    """Redelivered events with new times; only the rule that wants repeats gives them."""

    rows = [("a1", "a", 10, "g", ""), ("b1", "b", 20, "g", ""), ("a1", "a", 30, "g", ""), ("b1", "b", 40, "g", "")]
    rules = [rule("once", "ab"), rule("each", "ab", deduplicate=False)]
    found, _ = matches(spark, tmp_path, [rows[:2], rows[2:]], rules)
    pair = ("a1", "b1")
    assert found == [(0, '["g"]', pair), (1, '["g"]', pair), (1, '["g"]', pair)]
    assert found == in_batch(spark, rows, rules)


def test_a_group_starts_anew_after_the_horizon(spark, tmp_path):
    rows = [("a1", "a", 10, "g", ""), ("b1", "b", 20, "g", ""), ("a2", "a", 2000, "g", ""), ("b2", "b", 2010, "g", "")]
    rules = [rule("any", "ba", ordered=False), rule("steps", "abb")]
    kept, _ = matches(spark, tmp_path / "kept", [rows[:2], rows[2:]], rules)
    assert kept == [(0, '["g"]', ("b1", "a1")), (1, '["g"]', ("a1", "b1", "b2"))]
    anew, query = matches(spark, tmp_path / "anew", [rows[:2], rows[2:], end(50_000)], rules, "500 seconds")
    assert anew == [(0, '["g"]', ("b1", "a1")), (0, '["g"]', ("b2", "a2"))]


def keys_left(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


RECORDS = "idempotency_key string, us bigint, arrival bigint, fingerprint string, event_id string, valid boolean"


def records(spark, rows):
    df = spark.createDataFrame([(k, START + int(at * SECOND), n, f, f"{k}{n}", v) for k, at, n, f, v in rows], RECORDS)
    return df.withColumn("occurred_at", F.timestamp_micros("us"))


def by_hand(rows, horizon):
    """Outcomes of rows in (time, arrival) order."""

    claims, out = {}, []
    for key, at, n, fingerprint, valid in sorted(rows, key=lambda r: (r[1], r[2])):
        claim = claims.get(key)
        if claim is not None and (horizon is None or at <= claim[0] + horizon):
            out.append((key, n, "duplicate" if claim[1] == fingerprint else "conflict", claim[2]))
        elif valid:
            claims[key] = (at, fingerprint, f"{key}{n}")
            out.append((key, n, "imported", f"{key}{n}"))
        else:
            out.append((key, n, "failed", None))
    return sorted(out, key=str)


@pytest.mark.parametrize("horizon", [None, 100])
def test_claims_end_with_the_horizon(spark, tmp_path, horizon):
    r = random.Random(4)
    rows = [(f"k{r.randrange(8)}", n * 3, n, r.choice("fg"), r.random() < 0.7) for n in range(240)]
    # Within a batch rows come in any order; a hot key holds a third of them.
    rows += [("hot", 1 + n * 6, 1000 + n, r.choice("fg"), r.random() < 0.5) for n in range(120)]
    batches = [[x for x in rows if low <= x[1] < low + 240] for low in (0, 240, 480)]
    for batch in batches:
        r.shuffle(batch)
    frames = [records(spark, b) for b in [*batches, [("end", 10_000, 9999, "f", True)]]]
    text = None if horizon is None else f"{horizon} seconds"
    got, _ = played(spark, tmp_path, frames, lambda s: ops.stream_ingest(s, text, "300 seconds"))
    found = sorted(((x[0], x[1], x[2], x[3]) for x in got if x[0] != "end"), key=str)
    assert found == by_hand(rows, horizon)


def test_frames_of_a_batch_are_not_gathered(spark, tmp_path):
    """Small Arrow batches: the rows of one key come in many frames."""

    rows = [("k", 500 - n, n, "f" if n % 3 else "g", n % 2 == 0) for n in range(200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, _ = played(spark, tmp_path, [records(spark, rows)], lambda s: ops.stream_ingest(s))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got), key=str) == by_hand(rows, None)


def test_state_of_many_keys_stays_bounded(spark, tmp_path):
    """Five waves of new keys: without a horizon all stay, with one only the last wave's."""

    waves = [[(f"w{w}k{n}", w * 1000 + n / 10, w * 100 + n, "f", True) for n in range(60)] for w in range(5)]
    frames = [records(spark, w) for w in [*waves, [("end", 6000, 9999, "f", True)], [("end2", 9000, 10_000, "f", True)]]]
    _, kept = played(spark, tmp_path / "kept", frames, lambda s: ops.stream_ingest(s))
    _, ended = played(spark, tmp_path / "ended", frames, lambda s: ops.stream_ingest(s, "50 seconds", "10 seconds"))
    assert keys_left(kept) >= 300
    assert keys_left(ended) <= 10


def test_suppression_state_goes(spark, tmp_path):
    schema = "group_key string, suppression string, match_id string, first_us bigint"
    waves = [[(f"g{w}{n}", "", f"m{w}{n}", START + (w * 1000 + n) * SECOND) for n in range(40)] for w in range(4)]
    tail = [[("end", "", "end", START + 9000 * SECOND)], [("end2", "", "end2", START + 19_000 * SECOND)]]
    frames = [spark.createDataFrame(w, schema) for w in [*waves, *tail]]
    got, query = played(spark, tmp_path, frames, lambda s: ops.stream_suppression(s, 25.0, "100 seconds"))
    assert len([x for x in got if x["match_id"].startswith("m")]) == 160
    assert keys_left(query) <= 10


def test_a_replay_has_few_batches_however_many_files(spark, tmp_path):
    from witspark.plans.streams import BATCHES, replay

    rows = spark.range(400).repartition(20).select("id", F.timestamp_seconds(F.col("id") * 60).alias("occurred_at"))
    stream, _ = replay(spark, rows)
    ops.run_to_files(stream, str(tmp_path))
    assert len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*"))) <= BATCHES + 1
    assert spark.read.parquet(f"{tmp_path}/out").filter("NOT closing").count() == 400


def test_a_bucket_holds_many_groups(spark, tmp_path, monkeypatch):
    """Groups share frames, timers and waiting rows; repeats, quiet times and horizons stay their own."""

    monkeypatch.setattr(ops, "BUCKETS", 2)
    r = random.Random(5)
    rows = [(f"e{n}", r.choice("abc"), r.randrange(900), f"g{n % 30}", r.choice("st")) for n in range(240)]
    rows = [(i, t, at + k / 1000, g, s) for k, (i, t, at, g, s) in enumerate(rows)]
    rows += [(i, t, at + 950, g, s) for i, t, at, g, s in rows[::4]]
    batches = [rows[0::2], rows[1::2]]
    found, _ = matches(spark, tmp_path / "kept", batches, RULES)
    assert found == in_batch(spark, rows, RULES)
    ended, query = matches(spark, tmp_path / "ended", [*batches, end(50_000)], RULES, "500 seconds")
    assert {m[0] for m in ended} == set(range(len(RULES)))
    # Of the state of 180 groups only that of the closing rows may be left.
    assert keys_left(query) <= 30
