"""JSON texts that columns settle: same bytes as the Python walk, and a plan that spares Python."""

import json
import random
import re

from pyspark.sql import functions as F

from witspark.functions import redaction as R
from witspark.functions.jsonwalk import canonical_json, canonical_text, settled_json, strict_loads
from witspark.operators import redact


def by_python(text):
    try:
        return None if text is None else canonical_text(strict_loads(text))
    except (ValueError, RecursionError):
        return None


def value(r, depth=0):
    kind = r.randrange(10 if depth < 4 else 7)
    if kind == 0:
        return r.choice([0, -1, 7, 10**14, 10**15, 10**16, -(10**20), 10**40])
    if kind == 1:
        return r.choice([0.5, 1.0, 1e300, 1e-7, -0.0, 123456.25])
    if kind in (2, 3):
        return r.choice(["", "a b", "é", "x/y", "q\"q", "back\\slash", "tab\t", "1.5", "00:00.500Z", " ", "~\x7f", "a" * 40])
    if kind == 4:
        return r.choice([True, False, None])
    if kind in (5, 6):
        return r.randrange(1000)
    if kind in (7, 8):
        return {r.choice(["b", "a", "B", "z_1", "", "é", "key", "Z", "a.b", "10", "9"]): value(r, depth + 1) for _ in range(r.randrange(6))}
    return [value(r, depth + 1) for _ in range(r.randrange(4))]


ODD = [
    None, "", " ", "null", "true", "12", '"x"', "-0", "01", "1.", "1e2", "NaN", "[NaN]", "{", '{"a":1}x', '{"a":1} 2', "[1,]",
    '{"a":1,"a":2}', "{'a':1}", '{"a":1}\n', ' {"a":1}', '[1,\n2]', '{"b":1,"a":{"d":1,"c":2}}', "[" * 150 + "]" * 150,
    "[" * 3000 + "]" * 3000, "[1]" * 2, '"\\u0041"', '"\t"', "9" * 15, "9" * 16, "9" * 50, "//c\n1", "[1/**/]", '{"a":tru}',
]


def texts(seed, n=600):
    r = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        shown = json.dumps(value(r), ensure_ascii=r.random() < 0.3, separators=r.choice([(",", ":"), (", ", ": ")]))
        if r.random() < 0.1:  # damaged
            at = r.randrange(len(shown))
            shown = shown[:at] + r.choice('{}[]",:1e. x') + shown[at + r.randrange(2) :]
        out.append(shown)
    return out


def test_canonical_texts_keep_their_bytes(spark):
    given = texts(1)
    df = spark.createDataFrame(list(enumerate(given)), "n int, t string")
    rows = df.select("n", canonical_json(F.col("t")).alias("c"), settled_json(F.col("t")).alias("s")).collect()
    for row in rows:
        expected = by_python(given[row["n"]])
        assert row["c"] == expected, given[row["n"]]
        assert row["s"] in (None, expected), given[row["n"]]
    assert sum(r["s"] is not None for r in rows) > 100


def test_redacted_texts_keep_their_bytes(spark):
    r = random.Random(2)
    given = texts(3)
    for n in range(0, len(given), 5):
        secret = r.choice(["password", "Api-Key", "apiKEY", "note", "bearer abcdefghijklmnop", "a=b", "https://u:p@h/x"])
        given[n] = json.dumps({secret: "v" * r.randrange(30), "b": secret, "a": [1, 2]}, separators=(",", ":"))
    policy = R.Policy()
    apply = redact._redactor(policy)

    def plain(text):
        if text is None:
            return (None, 0, 0, None)
        try:
            done, count, size = apply(strict_loads(text))
            return (canonical_text(done), count, size, None)
        except (ValueError, RecursionError):
            return (None, 0, 0, "redaction_failed")

    df = spark.createDataFrame(list(enumerate(given)), "n int, t string")
    for row in df.select("n", redact.redact_json(F.col("t")).alias("r")).collect():
        assert tuple(row["r"]) == plain(given[row["n"]]), given[row["n"]]


def test_settled_texts_do_not_reach_python(spark):
    """What the Python step gets of a settled text is null."""

    df = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, '{"b": 1}')], "n int, t string")
    plan = df.select(canonical_json(F.col("t")).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ArrowEvalPython \[canonical\(CASE WHEN CASE WHEN", plan)
    settled = df.select("n", settled_json(F.col("t")).alias("s")).collect()
    assert [r["n"] for r in settled if r["s"] is None] == [2]


def test_short_decimals_and_plain_addresses_are_settled(spark):
    """The numbers and file addresses of event lines need no Python, and a row is redacted once."""

    lines = ['{"a":"file:///data/1.txt","v":29.61,"w":[0.0875,-3.5,0.0001,12345678901.25]}']
    odd = ["29.60", "0.00001", "1.23456", "123456789012.5", "1.5e3", "0.0", "1.0", "-0.0", "[1.,2]"]
    df = spark.createDataFrame(list(enumerate(lines + odd)), "n int, line string")
    rows = df.select("n", settled_json(F.col("line")).alias("s"), canonical_json(F.col("line")).alias("c")).collect()
    assert [r["n"] for r in rows if r["s"] is not None] == [0]
    assert [r["c"] for r in rows] == [by_python(t) for t in lines + odd]
    postgres = '{"a":"POSTGRES://u:p@h/x"}'
    safe = redact.with_redacted(df.union(spark.createDataFrame([(99, postgres)], df.schema)), "line", "r")
    plan = safe.filter("r.error IS NULL").select("r.json")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("parse_json") + plan.count("ParseJson") <= 2
    done = {r["n"]: r["r"]["json"] for r in safe.collect()}
    assert done[0] == lines[0] and done[99] == '{"a":"[REDACTED:database_url]"}'
