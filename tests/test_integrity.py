import hashlib
import hmac
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from witspark import schema as S
from witspark.functions.digest import hmac_sha256, uuid5_url
from witspark.functions.jsonwalk import canonical_text
from witspark.operators import integrity as I
from witspark.operators.validate import parse_events
from witspark.sources.journal import read_journal


def event(i, journal="j", payload=None):
    return {
        "causality": {
            "parent_event_id": f"{journal}{i - 1}" if i else None,
            "root_event_id": f"{journal}0",
            "sequence": i,
        },
        "classification": {"sensitivity": "public", "trust": "local"},
        "correlation": {"run_id": "r", "session_id": None, "span_id": None, "trace_id": "t"},
        "event_id": f"{journal}{i}",
        "event_type": "tool.execution.requested" if i else "agent.run.started",
        "integrity": {
            "canonicalization": S.CANONICALIZATION,
            "event_hash": None,
            "previous_event_hash": None,
        },
        "observed_at": "2024-01-01T00:00:00.500000Z",
        "occurred_at": "2024-01-01T00:00:00Z",
        "payload": payload or {},
        "principal": {
            "credential_id": None,
            "model_id": None,
            "on_behalf_of": None,
            "principal_id": "p",
            "principal_type": "human",
        },
        "source": {"component": "c", "instance_id": "i", "version": "1"},
        "spec_version": S.SPEC_VERSION,
    }


def chain(events):
    """Brute force: the lines of one journal."""
    last, lines = None, []
    for e in events:
        e = json.loads(json.dumps(e))
        e["integrity"]["previous_event_hash"] = last
        last = "sha256:" + hashlib.sha256(canonical_text(e).encode()).hexdigest()
        e["integrity"]["event_hash"] = last
        lines.append(canonical_text(e))
    return lines


PAYLOADS = [
    {},
    {"text": 'quote " slash / back \\ tab \t é ☃ \u001f', "n": 1},
    {"f": 0.1, "g": 1e-7, "h": 1e22, "i": 123456789.125, "big": 12345678901234567890123},
    {"evil": '"integrity":{"canonicalization":"x","event_hash":"sha256:1"', "z": [1, [2, {"a": None}]]},
    {"b": True, "l": [0.30000000000000004, -1.5]},
]


def lines_df(spark, journals):
    rows = [(j, i + 1, line, True) for j, lines in journals.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(
        rows, "journal_id string, record_number bigint, line string, terminated boolean"
    )


def verdicts(spark, journals, **options):
    return {r["journal_id"]: r for r in I.verify_chain(lines_df(spark, journals), **options).collect()}


def test_assign_equals_brute_force(spark):
    rows, want = [], {}
    for j in ("a", "b"):
        events = [event(i, j, p) for i, p in enumerate(PAYLOADS)]
        want[j] = chain(events)
        rows += [(j, i + 1, canonical_text(e)) for i, e in enumerate(events)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "journal_id string, record_number bigint, line string")
    got = I.assign_chain(df.repartition(3)).collect()
    for j in want:
        assert [r["line"] for r in sorted(got, key=lambda r: r["record_number"]) if r["journal_id"] == j] == want[j]


def test_tamper_matrix(spark):
    good = chain([event(i, payload=PAYLOADS[i % len(PAYLOADS)]) for i in range(6)])
    own = good[2].split('"event_hash":"')[1][:71]
    journals = {
        "sound": good,
        "deleted": good[:2] + good[3:],
        "inserted": good[:2] + [good[1]] + good[2:],
        "reordered": [good[0], good[2], good[1], *good[3:]],
        "cut_tail": good[:4],
        "flipped": good[:3] + [good[3].replace('"p"', '"q"')] + good[4:],
        "spaced": good[:1] + [good[1].replace(",", ", ", 1)] + good[2:],
        "empty": good[:1] + [""] + good[2:],
        "garbage": good[:1] + ["nope"] + good[2:],
        "no_hash": good[:2] + [good[2].replace(f'"{own}"', "null")] + good[3:],
        "label": good[:2] + [good[2].replace(S.CANONICALIZATION, "other/v1")] + good[3:],
        "carriage": good[:2] + [good[2] + "\r"] + good[3:],
        "missing_member": good[:1] + [good[1].replace('"span_id":null,', "")] + good[2:],
        "time_form": good[:1] + [good[1].replace("00:00:00Z", "00:00:00.000000Z")] + good[2:],
    }
    found = {k: (v["issue_code"], v["record_number"], v["records_verified"]) for k, v in verdicts(spark, journals).items()}
    assert found == {
        "sound": (None, None, 6),
        "deleted": ("sequence_mismatch", 3, 2),
        "inserted": ("sequence_mismatch", 3, 2),
        "reordered": ("sequence_mismatch", 2, 1),
        "cut_tail": (None, None, 4),
        "flipped": ("event_hash_mismatch", 4, 3),
        "spaced": ("noncanonical_record", 2, 1),
        "empty": ("empty_record", 2, 1),
        "garbage": ("parse_error", 2, 1),
        "no_hash": ("event_hash_missing", 3, 2),
        "label": ("unsupported_canonicalization", 3, 2),
        "carriage": ("noncanonical_record", 3, 2),
        "missing_member": ("noncanonical_record", 2, 1),
        "time_form": ("noncanonical_record", 2, 1),
    }


def test_trusted_end_finds_truncation(spark):
    good = chain([event(i) for i in range(4)])
    expected = spark.createDataFrame(
        [("j", 4, json.loads(good[3])["integrity"]["event_hash"]), ("gone", 1, "sha256:0")],
        "journal_id string, expected_count bigint, expected_hash string",
    )
    found = verdicts(spark, {"j": good[:3]}, expected=expected)
    assert found["j"]["issues"] == ["expected_record_count_mismatch", "expected_last_hash_mismatch"]
    assert not found["gone"]["ok"] and found["gone"]["records_verified"] == 0
    assert verdicts(spark, {"j": good}, expected=expected.filter("journal_id = 'j'"))["j"]["ok"]


ODD_LINES = [
    ('{"a":1}', "unknown_field"),
    ("[1]", "invalid_json"),
    ("{", "invalid_json"),
]


def test_parse_errors(spark):
    base = event(1)
    cases = [(canonical_text(base), None)] + ODD_LINES
    for path, value, error in [
        (("event_id",), "", "missing:event_id"),
        (("observed_at",), "2024-01-01T00:00:00", "invalid_timestamp:observed_at"),
        (("causality", "sequence"), -1, "invalid_sequence"),
        (("causality", "sequence"), True, "invalid_sequence"),
        (("causality", "parent_event_id"), None, "parent_required"),
        (("principal", "principal_type"), "robot", "invalid:principal_type"),
        (("correlation", "trace_id"), 5, "invalid:correlation.trace_id"),
        (("payload",), [1], "not_an_object:payload"),
        (("source", "x"), 1, "unknown_field:source"),
        (("spec_version",), "other", "unsupported_spec_version"),
    ]:
        changed = json.loads(json.dumps(base))
        target = changed
        for part in path[:-1]:
            target = target[part]
        target[path[-1]] = value
        cases.append((canonical_text(changed), error))
    for text, error in [('{"payload":{"x":NaN}}', "invalid_json"), ('{"event_id":"a","event_id":"b"}', "invalid_json")]:
        cases.append((text, error))
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, line string")
    found = {r["i"]: r["error"] for r in parse_events(df).select("i", "error").collect()}
    assert [found[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_large_journal_digest_tree(spark):
    df = spark.range(5000).select(
        F.lit("j").alias("journal_id"), (F.col("id") + 1).alias("n"), F.col("id").cast("string").alias("line")
    )
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000)]
    for _ in range(3):
        leaves = [
            hashlib.sha256("".join(leaves[i : i + I.FANOUT]).encode()).hexdigest()
            for i in range(0, len(leaves), I.FANOUT)
        ]
    got = I.ordered_digest(df, ["journal_id"], "n", F.col("line")).first()["digest"]
    assert got == "sha256:" + leaves[0]


@pytest.mark.parametrize("key", [b"short", b"x" * 64, b"y" * 100])
def test_hmac_and_uuid(spark, key):
    row = spark.range(1).select(
        hmac_sha256(key, F.lit("text é")).alias("h"), uuid5_url(F.lit("a:b:é")).alias("u")
    ).first()
    assert row["h"] == hmac.new(key, "text é".encode(), hashlib.sha256).hexdigest()
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "a:b:é"))


def test_journal_files(spark, tmp_path):
    (tmp_path / "one.jsonl").write_bytes(b"a\nb\r\nc\n")
    (tmp_path / "two.jsonl").write_bytes(b"x\n\ny")
    (tmp_path / "big.jsonl").write_bytes(b"".join(b"line %d\n" % i for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = read_journal(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {}
    for r in rows:
        by.setdefault(r["journal_id"].rsplit("/", 1)[1], []).append((r["record_number"], r["line"], r["terminated"]))
    assert sorted(by["one.jsonl"]) == [(1, "a", True), (2, "b\r", True), (3, "c", True)]
    assert sorted(by["two.jsonl"]) == [(1, "x", True), (2, "", True), (3, "y", False)]
    assert sorted(by["big.jsonl"]) == [(i + 1, f"line {i}", True) for i in range(20000)]


def loose(spark, events_by_journal):
    rows = [
        (journal, e["causality"]["sequence"] + 1, canonical_text(e))
        for journal, events in events_by_journal.items()
        for e in events
    ]
    return spark.createDataFrame(rows, "journal_id string, record_number bigint, line string")


def lines_of(df):
    return {(r["journal_id"], r["record_number"]): r["line"] for r in df.collect()}


def test_slices_give_the_chain_made_at_once(spark):
    events = {j: [event(i, j) for i in range(9)] for j in ("a", "b")}
    events["c"] = [event(0, "c")]
    whole = {(j, n + 1): line for j, own in events.items() for n, line in enumerate(chain(own))}
    ends, done = I.chain_ends(loose(spark, {"x": []})), {}
    for low, high in ((0, 3), (3, 4), (4, 9)):
        part = loose(spark, {j: own[low:high] for j, own in events.items()})
        appended, refused = I.continue_chain(part, ends)
        assert refused.count() == 0
        done |= lines_of(appended)
        ends = I.newer_ends(ends, appended)
    assert done == whole
    stored = spark.createDataFrame([(*k, v) for k, v in done.items()], "journal_id string, record_number int, line string")
    assert sorted(map(tuple, I.chain_ends(stored).collect())) == sorted(map(tuple, ends.collect()))


def test_wrong_next_numbers_are_refused(spark):
    own = [event(i, "a") for i in range(8)]
    stored, _ = I.continue_chain(loose(spark, {"a": own[:3]}), I.chain_ends(loose(spark, {"x": []})))
    new = loose(spark, {"a": [own[2], own[3], own[3], own[5], own[6]], "b": [event(4, "b")]})
    appended, refused = I.continue_chain(new, I.chain_ends(stored))
    # 3 is stored already, of 4 one is taken, 6 and 7 wait for 5; a new journal starts with 1.
    assert set(lines_of(appended)) == {("a", 4)}
    assert lines_of(appended)[("a", 4)] == chain(own[:4])[3]
    assert sorted(map(tuple, refused.collect())) == [("a", 3, 4), ("a", 4, 5), ("a", 6, 5), ("a", 7, 5), ("b", 5, 1)]


def test_appending_needs_a_sound_journal(spark):
    good, bad = [event(i, "g") for i in range(3)], [event(i, "b") for i in range(3)]
    lines = [("g", n + 1, line, True) for n, line in enumerate(chain(good[:2]))]
    lines += [("b", n + 1, line.replace('"p"', '"q"'), True) for n, line in enumerate(chain(bad[:2]))]
    stored = spark.createDataFrame(lines, "journal_id string, record_number bigint, line string, terminated boolean")
    late = loose(spark, {"g": [good[2]], "b": [bad[2]], "n": [event(0, "n"), event(2, "n")]})
    appended, failed = I.append_events(late, stored)
    assert lines_of(appended) == {("g", 3): chain(good)[2], ("n", 1): chain([event(0, "n")])[0]}
    assert sorted(map(tuple, failed.collect())) == [
        ("b", 3, "stored_chain_invalid"),
        ("n", 3, "sequence_mismatch: expected record 2"),
    ]


def test_lines_are_redacted_once_for_both_results(spark):
    lines = loose(spark, {"a": [event(i, "a") for i in range(3)], "b": [event(0, "b")]})
    broken = spark.createDataFrame([("a", 4, '{"a":1,"a":2}'), ("c", 1, "{")], lines.schema)
    appended, failed = I.append_events(lines.unionByName(broken))
    both = appended.groupBy("journal_id").count().join(failed, "journal_id", "full")
    rows = {(r["journal_id"], r["count"], r["record_number"], r["error"]) for r in both.collect()}
    assert rows == {("a", 3, 4, "redaction_failed"), ("b", 1, None, None), ("c", None, 1, "redaction_failed")}
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython [redact(") == 1
    assert lines_of(appended) == {("a", n + 1): line for n, line in enumerate(chain([event(i, "a") for i in range(3)]))} | {
        ("b", 1): chain([event(0, "b")])[0]
    }
