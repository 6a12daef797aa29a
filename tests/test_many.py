"""Very many rules, literals and patterns: same rows as one by one, and plans that do not grow."""

import json
import random

import pytest
from pyspark.sql import functions as F

from witspark.functions.payload import Resolver
from witspark.operators import detect, observe, redact
from witspark.operators.ruleindex import wanted_values
from witspark.operators.rules import Rule, Stage, rule_from_dict
from witspark.plans.lineage import broadcast_if_small

RESOLVER = Resolver("payload_v", {"g": "grp"})


@pytest.fixture
def indexed(spark):
    spark.conf.set("witspark.indexedStages", "1")
    yield
    spark.conf.unset("witspark.indexedStages")


def events(spark, rows):
    df = spark.createDataFrame(
        [(f"e{n}", t, n * 1_000_000, n, g, json.dumps(p)) for n, (t, g, p) in enumerate(rows)],
        "event_id string, event_type string, us bigint, sequence bigint, grp string, payload string",
    )
    return df.withColumn("occurred_at", F.timestamp_micros("us")).withColumn("payload_v", F.parse_json("payload"))


VALUES = ["x", "y", "", "1", 1, 1.0, -0.0, 0, 2.5, True, False, None, [1], {"a": 1}]
EXPECTED = [
    "x", "", "1", 1, 0, 2.5, True, False, None, {"in": ["x", 1, True]}, {"in": []}, {"exists": True},
    {"exists": False}, {"not": "x"}, {"prefix": "x"}, {"gte": 1}, {"regex": "^[xy]$"}, {"in": ["y", "y", 2.5]},
]


def sample(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(160):
        payload = {p: r.choice(VALUES) for p in ("p", "q") if r.random() < 0.9}
        rows.append((r.choice("abc"), r.choice("uvw"), payload | {"deep": {"r": r.choice(VALUES)}, "s": r.choice("st")}))
    rules = []
    for n in range(60):
        stages = []
        for _ in range(r.choice([1, 2, 3])):
            paths = r.sample(["p", "q", "deep.r"], r.choice([0, 1, 1, 2]))
            stages.append(Stage(r.choice("abc"), {p: r.choice(EXPECTED) for p in paths}))
        options = {"suppression_seconds": 5.0, "suppression_key": ("s",)} if n % 7 == 0 else {}
        keys = ("g",) if n % 3 else ("g", "p")
        rules.append(Rule(f"r{n}", "n", tuple(stages), group_by=keys, ordered=n % 5 != 0, **options))
    return rows, rules


def shown(df):
    return sorted(
        (r["rule_id"], tuple(r["group_key"]), tuple(r["event_ids"]), r["first_us"], r["last_us"]) for r in df.collect()
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_index_gives_the_candidates_of_single_rules(spark, seed, indexed):
    rows, rules = sample(seed)
    df = events(spark, rows)
    found = {tuple(map(str, r)) for r in detect.candidates(df, rules, RESOLVER).collect()}
    spark.conf.set("witspark.indexedStages", "1000000")
    assert found == {tuple(map(str, r)) for r in detect.candidates(df, rules, RESOLVER).collect()}
    assert found


def test_index_gives_the_same_matches(spark, indexed):
    rows, rules = sample(3)
    df = events(spark, rows)
    # Ordered rules alone: unordered ones are a plan each.
    rules = [r for r in rules if r.ordered]
    found = shown(detect.evaluate_rules(df, rules, resolver=RESOLVER))
    spark.conf.set("witspark.indexedStages", "1000000")
    assert found == shown(detect.evaluate_rules(df, rules, resolver=RESOLVER))


def test_events_of_many_ordered_rules_are_no_row_per_rule(spark, indexed, monkeypatch):
    """The candidates, a row per rule and event, are not made; groups, repeats and windows are kept."""

    r = random.Random(9)
    rows = [(r.choice("ab"), r.choice("uv"), {"p": r.choice("xyz"), "q": r.choice([1, 2, True])}) for _ in range(120)]
    df = events(spark, rows)
    # Repeated ids at other times, and the same rows once more.
    later = df.withColumn("us", F.col("us") + 130_000_000).withColumn("occurred_at", F.timestamp_micros("us"))
    df = df.unionByName(later.filter("sequence % 3 > 0")).unionByName(df.filter("sequence % 5 = 0"))
    rules = [
        Rule(
            f"r{n}\\'", "n", tuple(Stage(r.choice("ab"), {p: r.choice(EXPECTED)} if n % 4 else {}) for p in "pqp"[: 1 + n % 3]),
            group_by=(("g",), ("g", "p"), ())[n % 3 if n % 2 else 0], deduplicate=n % 5 > 0,
            within_seconds=3.0 if n % 7 == 0 else None,
            **({"suppression_seconds": 4.0, "suppression_key": ("q",)} if n % 11 == 0 else {}),
        )
        for n in range(80)
    ]
    spark.conf.set("witspark.indexedStages", "1000000")
    expected = shown(detect.evaluate_rules(df, rules, resolver=RESOLVER))
    spark.conf.set("witspark.indexedStages", "1")

    def refused(*args):
        raise AssertionError("a row per rule and event")

    monkeypatch.setattr(detect, "candidates", refused)
    found = shown(detect.evaluate_rules(df, rules, resolver=RESOLVER))
    assert found == expected and len(set(found)) < len(found)
    for name, size in (("FLUSH_MATCHES", 3), ("FLUSH_EVENTS", 2)):
        monkeypatch.setattr(f"witspark.operators.ruleindex.{name}", size)
        assert shown(detect.evaluate_rules(df, rules, resolver=RESOLVER)) == expected


def test_stages_beyond_one_mask_word(spark, indexed):
    rule = Rule("long", "long", tuple(Stage("a", {"k": i}) for i in range(70)), group_by=("g",))
    df = events(spark, [("a", "u", {"k": i}) for i in range(70)])
    assert detect.evaluate_rules(df, [rule], resolver=RESOLVER).first()["event_ids"] == [f"e{i}" for i in range(70)]


def test_the_plan_does_not_grow_with_rules(spark, indexed):
    def joins(n):
        rules = [Rule(f"r{i}", "n", (Stage("a", {"k": i}), Stage("b", {"k": i, "q": "x"})), group_by=("g",)) for i in range(n)]
        df = events(spark, [("a", "u", {"k": 1})])
        plan = detect.candidates(df, rules, RESOLVER)._jdf.queryExecution().optimizedPlan()
        return plan.toString().count("Join "), plan.toString().count("variant_get")

    assert joins(10) == joins(500)


def test_which_predicates_are_looked_up():
    assert wanted_values("x") == ["x"] and wanted_values({"in": [1, True]}) == [1, True]
    assert [wanted_values(e) for e in (None, {"not": "x"}, {"exists": True}, {"in": [None]}, {"in": [[1]]})] == [None] * 5


def test_quality_requirements_are_a_list(spark):
    data = {"name": "x", "required_evidence_quality": ["verified", "observed"], "stages": [{"event_type": "a"}]}
    df = events(spark, [("a", "u", {})])
    match = detect.evaluate_rules(df, [rule_from_dict(data)], resolver=RESOLVER).first()
    assert match["required_evidence_quality"] == ["verified", "observed"]
    none = detect.evaluate_rules(df, [rule_from_dict({"name": "y", "stages": [{"event_type": "a"}]})], resolver=RESOLVER)
    assert none.first()["required_evidence_quality"] == []
    with pytest.raises(ValueError):
        rule_from_dict(data | {"required_evidence_quality": [1]})


def audited(spark, texts, canaries):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = redact.leak_audit(df, ["id"], "text", canaries).filter("pattern LIKE 'extra_%'").collect()
    return sorted((r["id"], r["pattern"]) for r in rows)


def test_many_literals_equal_single_ones(spark, monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("abcé") for _ in range(60)) for _ in range(60)] + [None, "", "a" * 5000]
    canaries = ["".join(r.choice("abcé") for _ in range(r.choice([1, 2, 4, 6]))) for _ in range(80)] + ["", None, "aa", "aa"]
    expected = sorted(
        (n, f"extra_canary_{i}") for n, t in enumerate(texts) for i, c in enumerate(canaries) if t and c and c in t
    )
    assert audited(spark, texts, canaries) == expected
    monkeypatch.setattr(redact, "LITERAL_BYTES", 40)  # several automata
    assert audited(spark, texts, canaries) == expected


def test_only_patterns_that_expectations_hold_are_put_together(spark):
    """Records meet the patterns of their own key's expectations alone."""

    expect = spark.createDataFrame(
        [(1, "u", "GET", None, None), (2, "v", None, "d", 200), (3, "n", None, None, None), (4, None, None, None, None)],
        "id int, url string, method string, body_digest string, status_code int",
    )
    entries = spark.createDataFrame(
        [(n, key, m, d, s) for n, (key, m, d, s) in enumerate(
            [("u", "get", "d", 200), ("v", "post", "d", 200), ("v", "get", "e", 200)] + [("w", "get", "d", n) for n in range(50)]
        )],
        "ordinal int, url string, method string, body_digest string, status_code int",
    )
    seen = []
    lookup = observe._lookup

    def counted(*args):
        table = lookup(*args)
        seen.append(table.select("key", "pattern").distinct().collect())
        return table

    observe._lookup = counted
    try:
        rows = {r["id"]: (r["outcome"], r["exact_count"], r["candidate_count"]) for r in observe.match_access_log(expect, entries).collect()}
    finally:
        observe._lookup = lookup
    assert rows == {1: ("observed", 1, 1), 2: ("observed", 1, 2), 3: ("unverified", 0, 0), 4: ("unverified", 0, 0)}
    assert sorted(map(tuple, seen[0])) == [("u", 1), ("v", 6)]
    assert sorted(map(tuple, seen[1])) == [("u", 1), ("v", 0)]


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    def hinted(df):
        return "ResolvedHint" in broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()

    rows = spark.range(100).select("id", F.lit("x" * 1000).alias("s"), F.array(F.lit("y" * 1000)).alias("a"))
    assert hinted(rows) and hinted(rows.limit(0)) and hinted(spark.createDataFrame([(None, None)], "s string, b binary"))
    for name, value in (("witspark.broadcastRows", "99"), ("witspark.broadcastBytes", "150000")):
        spark.conf.set(name, value)
        assert not hinted(rows)
        spark.conf.unset(name)


def test_stages_of_one_type_share_a_mask_and_others_need_none():
    from witspark.operators.rules import Rule, Stage
    from witspark.operators.ruleindex import Index

    shared = Rule("s", "s", (Stage("a", {}), Stage("a", {}), Stage("b", {})))
    found = Index([shared]).by_type
    assert [entry[-1] for entry in found["a"]] == [False, False]
    assert [entry[-1] for entry in found["b"]] == [True]
