"""Cases that once lost, invented or mixed up results."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from test_detect import brute_ordered, events, resolver, sample
from witspark.operators import contract as C
from witspark.operators import detect, export, integrity, project, report
from witspark.operators.rules import Rule, Stage, rule_from_dict
from witspark.plans.lineage import written_table
from witspark.streaming import ops


def mixed_rules():
    return [
        Rule("once", "once", (Stage("a"), Stage("b"))),
        Rule("all", "all", (Stage("b"), Stage("c"), Stage("a")), deduplicate=False),
        Rule("free", "free", (Stage("c"), Stage("a")), ordered=False),
    ]


def listed(df):
    return sorted((r["rule_id"], r["group_key"][0], tuple(r["event_ids"])) for r in df.collect())


@pytest.mark.parametrize("side", ["alone", "left", "right"])
def test_hot_path_is_exact_under_unions(spark, side):
    rows = sample(11, n=400, groups=2)
    df = events(spark, rows)

    def found():
        return detect.evaluate_rules(df, mixed_rules(), resolver=resolver())

    expected = listed(found())
    assert [x[1:] for x in expected if x[0] == "once"] == [
        (g, tuple(ids)) for g, ids in brute_ordered(rows, "ab")
    ]
    spark.conf.set("witspark.hotRows", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = found()
        nothing = spark.range(0, 8, 1, 8).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in hot.schema.fields]
        ).filter("rule_id IS NOT NULL OR rand() < 0")
        if side == "left":
            hot = hot.unionByName(nothing)
        elif side == "right":
            hot = nothing.unionByName(hot)
        assert listed(hot) == expected
    finally:
        spark.conf.unset("witspark.hotRows")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rules_with_more_stages_than_one_word_has_bits(spark):
    kinds = [f"k{i}" for i in range(130)]
    rows = [(f"e{i}", i, "g", kind) for i, kind in enumerate(kinds)]
    rules = [Rule("long", "long", tuple(Stage(k) for k in kinds)), Rule("free", "free", tuple(Stage(k) for k in kinds[60:70]), ordered=False)]
    found = listed(detect.evaluate_rules(events(spark, rows), rules, resolver=resolver()))
    assert [(r, len(ids)) for r, _, ids in found] == [("free", 10), ("long", 130)]


def test_suppression_computes_its_matches_once(spark):
    rule = Rule("r", "r", (Stage("a"),), suppression_seconds=10)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    detect.evaluate_rules(events(spark, sample(3)), [rule], resolver=resolver())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before)
    # Two jobs for the fold and its copy, the rest count groups of what is kept.
    assert jobs <= 8


@pytest.mark.parametrize("changed", [1, 13, 500, 999, 1000])
def test_digest_of_a_journal_covers_every_record(spark, monkeypatch, changed):
    monkeypatch.setattr(integrity, "FANOUT", 2)
    df = spark.range(1, 1001).select(F.lit("j").alias("journal_id"), F.col("id").alias("n"), F.col("id").cast("string").alias("line"))
    other = df.withColumn("line", F.when(F.col("n") == changed, "x").otherwise(F.col("line")))
    digests = {
        integrity.ordered_digest(d, ["journal_id"], "n", F.col("line")).first()["digest"] for d in (df, other)
    }
    assert len(digests) == 2


def test_regex_reads_long_texts(spark):
    rows = [("e0", 0, "g", "a", '{"s":"' + "a" * 9000 + 'z"}')]
    rule = Rule("r", "r", (Stage("a", {"s": {"regex": "az$"}}),))
    assert len(detect.evaluate_rules(events(spark, rows), [rule], resolver=resolver()).collect()) == 1


def test_timeline_filter_reads_escapes(spark):
    rows = [("e1", '{"a":{"tool_name":"safe/x"}}'), ("e2", '{"a":{"tool_name":"safe\\/x"}}'), ("e3", '{"a":{"tool_name":"saf\\u0065/x"}}'), ("e4", '{"a":{"tool_name":"other"}}')]
    df = spark.createDataFrame(rows, "event_id string, payload string")
    key = project.TOOL_KEYS[0]
    df = df.withColumn("payload", F.replace("payload", F.lit("tool_name"), F.lit(key)))
    found = project.filtered_timeline(df, tool_name="safe/x")
    assert {r["event_id"] for r in found.collect()} == {"e1", "e2", "e3"}


def test_repeated_ids_do_not_multiply_link_faults(spark):
    link = "struct<subject_event_id:string,evidence_event_id:string,relationship:string,verification_status:string,observer_identity:string,corroboration_type:string>"
    rows = [
        ("l", "link", 9, ("s", "p", "supports", "verified", "o", "c")),
        *[(i, kind, n, None) for n, (i, kind) in enumerate([("s", "act"), ("s", "act"), ("p", "obs"), ("p", "obs")])],
    ]
    df = spark.createDataFrame(
        [("r", *row) for row in rows], f"run_id string, event_id string, event_type string, sequence int, evidence_link {link}"
    )
    need = C.LinkRequirement("link", relationship="limits")
    assert C.check_links(df, need, ["run_id"]).count() == 1


def test_derived_tables_follow_their_source(spark, tmp_path):
    source = f"{tmp_path}/source"
    seen = []
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(source)
        time.sleep(0.01)
        seen.append(written_table(spark, "test", source, lambda: spark.read.parquet(source)).count())
    assert seen == [3, 5]


def test_dotted_keys_are_members_of_their_own(spark):
    def diff(a, b):
        make = lambda text: spark.createDataFrame([(1, text)], "id int, report string")
        return sorted((r["path"], r["change"]) for r in report.json_diff(make(a), make(b), ["id"]).collect())

    same = '{"a.b":1,"a":{"b":2},"c[0]":1,"c":[1]}'
    assert diff(same, same) == []
    assert diff('{"v.1":1}', "{}") == [('$["v.1"]', "removed")]
    assert diff('{"a.b":1,"a":{"b":2}}', '{"a.b":1,"a":{"b":3}}') == [("$.a.b", "value")]


def test_two_reports_compare_as_their_nodes_do():
    rng = random.Random(5)

    def value(depth=0):
        draw = rng.random()
        if depth < 3 and draw < 0.35:
            return {rng.choice(["a", "b", "c.d", "", "marker"]): value(depth + 1) for _ in range(rng.randrange(4))}
        if depth < 3 and draw < 0.55:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return rng.choice([0, 1, 1.0, 0.0, -0.0, True, None, "x", "1", "", "witspark.capture.v1", "\\"])

    seen = 0
    for _ in range(4000):
        first = {"a": value(), "b": value()} if rng.random() < 0.7 else value()
        second = json.loads(json.dumps(first))
        if isinstance(second, dict):
            second[rng.choice("abc")] = value()
        texts = [json.dumps(v) for v in (first, second if rng.random() < 0.7 else value())]
        if rng.random() < 0.05:
            texts[rng.randrange(2)] = rng.choice(["{", '{"a":1,"a":2}', "[NaN]", "1e400"])
        found = report._pair_differences(*texts)
        nodes = report._differences(*[report._node_counts([t]) for t in texts])
        seen += found is not None
        assert found is None or sorted(found) == sorted(nodes), texts
    assert seen > 2000


def test_reports_go_through_one_shuffle_and_their_nodes_through_none(spark):
    schema = "id int, report string"
    left = [(1, '{"a":1,"b":{"c":1}}'), (2, '{"a":1}'), (2, '{"a":1}'), (3, '{"a":1}'), (None, '{"a":1}'), (4, None)]
    right = [(1, '{"a":2,"d":[]}'), (2, '{"a":2}'), (2, '{"a":1}'), (None, '{"a":2}'), (4, '{"a":2}'), (5, "{}")]
    found = report.json_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # Two reports on each side meet in four ways, and so do the nodes that hold what differs.
    assert sorted((r["id"], r["path"], r["change"]) for r in found.collect()) == sorted(
        [(1, "$.a", "value"), (1, "$.b", "removed"), (1, "$.d", "added")] + [(2, "$.a", "value")] * 8
    )


def test_odd_numbers_are_found_behind_one_class(spark):
    from witspark.operators.validate import _ODD_NUMBER

    odd = ['":1e5', '[1E', 'x,-0.00001', '":12345678901234567', '[-1.5e', '":-0.0000', ',,1..e', '[1e5"', '\n[1e']
    even = [':1e5', '":1234567890123456', '["1e5"', '":e5', '-0.0000', "12:00:00.5"]
    df = spark.createDataFrame([(t,) for t in odd + even], "line string")
    assert [r[0] for r in df.select(F.col("line").rlike(_ODD_NUMBER)).collect()] == [True] * len(odd) + [False] * len(even)
    # A class, not an alternation, is tried at every place of a line.
    assert _ODD_NUMBER.startswith("[:,")


def test_no_text_of_an_event_is_an_export_slot():
    assert "@event" != export._slot("event") and export._slot("event").startswith("@event-")
    assert export._slot("event") == export._slot("event") != export._slot("objects")


def test_case_files_follow_the_rows_of_a_case(spark, tmp_path):
    from witspark.sources.journal import write_case_bundles

    # Whatever the sizes of the written files, no piece holds more than it should.
    df = spark.range(1000).select(
        F.when(F.col("id") < 990, "big").otherwise("small").alias("run_id"),
        F.timestamp_seconds("id").alias("occurred_at"),
        F.col("id").alias("sequence"),
        F.col("id").cast("string").alias("event_id"),
        F.col("id").cast("string").alias("line"),
    )
    summary = df.groupBy("run_id").agg(F.lit("n").alias("field"), F.lit("v").alias("value"), F.count(F.lit(1)).alias("events"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_case_bundles(df, f"{tmp_path}/out", summary, rows_per_file=100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {c: sum(f["case_id"] == c and f["part"] == "events" for f in files) for c in ("big", "small")}
    assert parts["small"] == 1 and parts["big"] >= 4
    assert sum(f["size_bytes"] for f in files if f["part"] == "events") == sum(len(str(i)) + 1 for i in range(1000))


def test_many_small_cases_are_written_and_listed_by_as_many_tasks_as_their_files_need(spark, tmp_path):
    from witspark.sources import journal

    df = spark.range(400).select(
        F.concat(F.lit("case_"), F.col("id") % 200).alias("run_id"),
        F.timestamp_seconds("id").alias("occurred_at"),
        F.col("id").alias("sequence"),
        F.col("id").cast("string").alias("event_id"),
        F.col("id").cast("string").alias("line"),
    )
    summary = df.groupBy("run_id").agg(F.lit("n").alias("field"), F.lit("v").alias("value"), F.count(F.lit(1)).alias("events"))
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    files = journal.write_case_bundles(df, f"{tmp_path}/out", summary).collect()
    assert spark.conf.get(name) == before
    with journal.listing(spark):
        assert int(spark.conf.get(name)) <= journal.LISTING_TASKS
    assert len(files) == 400 and len({(f["case_id"], f["part"]) for f in files}) == 400
    for part in ("events", "summary"):
        tasks = {f["path"].rsplit("/", 1)[1][:10] for f in files if f["part"] == part}
        assert 2 <= len(tasks) <= 200 // journal.FILES_PER_TASK


def test_late_matches_are_suppressed_in_event_order(spark, tmp_path):
    ops.use_rocksdb(spark)
    second = 1_000_000
    batches = [[("m3", 30), ("m9", 90)], [("m1", 10), ("m4", 45)], [("end", 10_000)]]
    schema = "group_key string, suppression string, match_id string, first_us bigint"
    folder = f"{tmp_path}/in"
    for batch in batches:
        rows = [("g" if m != "end" else "end", "", m, t * second) for m, t in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ops.run_to_files(ops.stream_suppression(stream, 25.0, "600 seconds"), f"{tmp_path}/run")
    got = sorted(r["match_id"] for r in spark.read.parquet(f"{tmp_path}/run/out").collect())
    # 10 is kept, 30 lies within 25 s of it, 45 does not, 90 is free again.
    assert got == ["m1", "m4", "m9"]


def test_rule_metadata_reaches_the_alerts(spark):
    rule = rule_from_dict(
        {"name": "x", "version": 3, "tags": ["t1", "t2"], "required_evidence_quality": "verified", "stages": [{"event_type": "a"}]}
    )
    rows = [("e0", 0, "g", "a")]
    alert = detect.alert_rows(detect.evaluate_rules(events(spark, rows), [rule], resolver=resolver())).first()
    assert (alert["rule_version"], alert["tags"], alert["required_evidence_quality"]) == ("3", ["t1", "t2"], ["verified"])


def test_random_groups_at_both_settings(spark, hot):
    random.seed(0)
    rows = sample(21, n=300, groups=4)
    rule = Rule("r", "r", (Stage("a"), Stage("b"), Stage("c")))
    found = detect.evaluate_rules(events(spark, rows), [rule], resolver=resolver())
    assert sorted((r["group_key"][0], r["event_ids"]) for r in found.collect()) == brute_ordered(rows, "abc")


def test_case_files_are_written_and_listed_some_at_a_time(spark, tmp_path, monkeypatch):
    """The driver never holds the paths of all files: 60 cases with two files each, 30 files at a time."""

    from witspark.sources import journal

    df = spark.range(180).select(
        F.when(F.col("id") % 60 > 0, F.concat(F.lit("case/ "), F.col("id") % 60)).alias("run_id"),
        F.timestamp_seconds("id").alias("occurred_at"),
        F.col("id").alias("sequence"),
        F.col("id").cast("string").alias("event_id"),
        F.col("id").cast("string").alias("line"),
    )
    summary = df.groupBy("run_id").agg(F.lit("n").alias("field"), F.lit("v").alias("value"), F.count(F.lit(1)).alias("events"))

    def shown(rows):
        return sorted((r["case_id"], r["part"], r["size_bytes"], r["sha256"]) for r in rows)

    whole = shown(journal.write_case_bundles(df, f"{tmp_path}/whole", summary).collect())
    listed, scan = [], journal.scan_artifacts
    monkeypatch.setattr(journal, "FILES_PER_ROUND", 30)
    monkeypatch.setattr(journal, "scan_artifacts", lambda *a: listed.append(scan(*a).count()) or scan(*a))
    found = journal.write_case_bundles(df, f"{tmp_path}/out", summary)
    assert shown(found.collect()) == whole and len(whole) == 118  # a case without a name has no folder
    assert len(listed) == 4 and max(listed) < 118 and sum(listed) == 118
