import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from witspark.functions import redaction as R
from witspark.operators import redact

SECRET = "hunter2hunter2"


def apply(value, **options):
    return redact._redactor(R.Policy(**options))(value)


leaf = st.none() | st.booleans() | st.integers() | st.text(max_size=30)
tree = st.recursive(
    leaf,
    lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "Pass-Word", "token", "x"]), c, max_size=3),
    max_leaves=12,
)


@settings(max_examples=80, deadline=None)
@given(tree)
def test_no_secret_survives(value):
    document = {"password": value, "note": f"password = {SECRET}", "rest": value}
    shown = json.dumps(apply(document)[0])
    assert SECRET not in shown
    assert json.loads(shown)["password"]["value"] == R.REDACTED_VALUE


@settings(max_examples=40, deadline=None)
@given(st.text(min_size=0, max_size=80))
def test_capture_bound_holds(text):
    value, count, size = apply({"t": text}, max_text=16)
    captured = value["t"]
    if isinstance(captured, dict):
        assert count == 1 and len(captured["value"]) == 16 and captured["truncated"]
    else:
        assert len(captured) <= 16 and count == size == 0


def test_exempt_paths_are_not_cut_but_still_redacted():
    value, count, _ = apply({"event_id": "e" * 50 + " password=" + SECRET}, max_text=10)
    assert count == 0 and SECRET not in value["event_id"] and len(value["event_id"]) > 50


def test_failures_close(spark):
    rows = [("ok", '{"a":"b"}'), ("dup", '{"a":1,"a":2}'), ("nan", '{"a":NaN}'), ("cut", '{"a":')]
    rows.append(("deep", "[" * 80 + "]" * 80))
    df = spark.createDataFrame(rows, "id string, payload string")
    found = {r["id"]: r for r in redact.redact_fields(df).collect()}
    assert found["ok"]["payload"] == '{"a":"b"}' and found["ok"]["redaction_error"] is None
    for bad in ("dup", "nan", "cut", "deep"):
        assert found[bad]["payload"] is None and found[bad]["redaction_error"] == "redaction_failed"


def test_budget_fails_closed():
    document = {f"k{i}": "x" * 20 for i in range(5)}
    assert apply(document, max_text=10, max_captures=5)[1] == 5
    try:
        apply(document, max_text=10, max_captures=4)
    except ValueError as exc:
        assert "budget" in str(exc)
    else:
        raise AssertionError("budget not enforced")


def test_column_patterns_equal_the_row_form(spark):
    texts = [
        "Bearer abcdefgh12345678 x",
        "mongodb+srv://u:p@h/db end",
        "https://h/?token=abcdefghij&v=1",
        "api-key: 'abcdefgh' and SECRET=zyxwvuts",
        "xtoken=abcdefghij no hit",
        "-" * 5 + "BEGIN PRIV" + "ATE KEY" + "-" * 5 + "\nq\n" + "-" * 5 + "END PRIV" + "ATE KEY" + "-" * 5,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    column = [r[0] for r in df.select(R.redact_text(F.col("t"))).collect()]
    assert column == [apply(t)[0] for t in texts]


def test_log_form_hides_captures(spark):
    df = spark.createDataFrame([('{"big":"%s","n":1}' % ("x" * 600),), ("{",)], "t string")
    first, second = [json.loads(r[0]) for r in df.select(redact.log_safe_json(F.col("t"))).collect()]
    assert first["big"]["value"] == R.LOG_CAPTURE_VALUE and first["big"]["original_length"] == 600
    assert first["big"]["digest"].startswith("sha256:") and first["n"] == 1
    assert second["marker"] == R.LOG_FAILURE_MARKER


LITERAL = [
    ("Authorization: Bearer abcdefgh12345678 end", "Authorization: Bearer [REDACTED:bearer_token] end"),
    ("see postgres://user:pw@host/db now", "see [REDACTED:database_url] now"),
    ("https://x/y?sig=abcdefgh1&z=1", "https://x/y?sig=[REDACTED:secret]&z=1"),
    ("password = hunter2hunter2!", "password=[REDACTED:secret]!"),
    ("password = short", "password = short"),
    ("a-----BEGIN PRIVATE KEY-----\nxyz\n-----END PRIVATE KEY-----b", "a[REDACTED:private_key]b"),
    ("nothing to hide: tokens and keys", "nothing to hide: tokens and keys"),
]


@pytest.mark.parametrize("text, expected", LITERAL)
def test_patterns_by_literal_cases(spark, text, expected):
    """Written down by hand, not derived from the patterns."""

    df = spark.createDataFrame([(text,)], "t string")
    column = F.col("t")
    for name, pattern, replacement in R.PATTERNS:
        column = R.replace_pattern(column, name, pattern, replacement)
    assert df.select(column).first()[0] == expected


@pytest.mark.parametrize(
    "text, leaks",
    [("XYZ_CANARY_1", True), ("ghp_" + "a" * 20, True), ("sk-" + "b" * 19, False), ("Bearer " + "c" * 16, True)],
)
def test_leaks_by_literal_cases(spark, text, leaks):
    import re

    assert any(re.search(pattern, text) for _, pattern in R.LEAK_PATTERNS) == leaks


@settings(max_examples=120, deadline=None)
@given(value=tree)
def test_short_cut_equals_the_walk(value):
    """Texts that skip the walk come out as the walk would give them."""

    text = json.dumps(value, ensure_ascii=False)
    policy = R.Policy()
    if redact._harmless(policy)(text):
        assert redact._redactor(policy)(json.loads(text)) == (json.loads(text), 0, 0)
