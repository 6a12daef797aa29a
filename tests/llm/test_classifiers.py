"""Quality, toxicity and quality rules: brute force and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from witspark.llm import fertility, toxic, zquality
from witspark.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def held(doc, parts, rest):
    return (zlib.crc32(str(doc).encode()) % parts == rest)


@pytest.mark.parametrize(
    "name, label, parts, rest, least", [("op3_quality_classifier", "quality", 3, 1, 0.9), ("op7_toxicity", "toxic", 5, 0, 0.9)]
)
def test_held_out_accuracy(spark, sf_dir, name, label, parts, rest, least):
    rows = QUERIES[name](spark, SF).collect()
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"], parts, rest) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in tested) / len(tested) > least


def test_scores_do_not_see_held_out_labels(spark, sf_dir):
    """Turning the held-out labels round changes no score."""

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    use = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(test, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert zquality.fit(docs, labels, use) == zquality.fit(docs, turned, use)


def brute_segments(scores):
    """Maximal segments by definition: the best segment, then left and right of it."""

    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-9 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j + 1)
    if best is None:
        return []
    _, a, b = best
    return (
        brute_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]
    )


def test_segments_by_brute_force():
    random.seed(4)
    for _ in range(500):
        scores = [random.choice([-3, -2, -1, 1, 2, 3]) + random.random() / 100 for _ in range(random.randrange(14))]
        assert [(a, b) for a, b, _ in toxic.segments(scores)] == brute_segments(scores)


def test_toxic_passages(spark, sf_dir):
    model = toxic.Model({b"bad": 4.0, b"worse": 6.0}, -0.5, 1.0, 0.01, 2.0, -3.0)
    df = spark.createDataFrame(
        [(1, "all is good here"), (2, "So bad, WORSE! words " * 3 + "fine words " * 40 + "bad worse"), (3, None)],
        "doc_id int, text string",
    )
    rows = {r["id"]: r for r in toxic.score(df, model).collect()}
    assert rows[2]["score"] > 0.9 > rows[1]["score"] == rows[3]["score"]
    assert len(rows[2]["passages"]) == 2 and rows[1]["passages"] == []


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside), failed


def test_query_op6(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op6_quality_rules"](spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        r = rows[doc]
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert own == brute_rules(text), doc
        assert not (r["base_failed"] and r["kept"])


def test_fertility_measures_equal_the_library(spark, texts):
    second = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    own = fertility.Fertility(open(PIECES, "rb").read(), second)
    whole = fertility.wordbpe.Counter(second)
    for text in list(texts.values())[:60] + ["漢字かな", "\U0001f600\U0001f600 ok"]:
        words = text.encode().split()
        expected = [i for w in words for i in own.model.encode(w.decode(), num_threads=1)]
        n, _, fallback, _, other = own.measures(*own.tokens([words])[0], 10)
        assert n == len(expected)
        # By words, the second vocabulary counts what it counts over the whole text.
        assert other == (10 / whole.counts([text])[0] if n else 0.0)
        assert fallback == pytest.approx(sum(own.model.is_byte(i) for i in expected) / max(1, n))


def test_bands_reject_what_no_language_gives(spark):
    good = " ".join(f"the story of number {i} goes on with many other words" for i in range(12))
    random.seed(1)
    noise = " ".join("".join(random.choice("QXZJKVW0123456789") for _ in range(9)) for _ in range(80))
    cyrillic = " ".join(f"это рассказ номер {i} и он идёт дальше с другими словами" for i in range(12))
    df = spark.createDataFrame([(1, good), (2, noise), (3, cyrillic), (4, "กข " * 100)], "doc_id int, text string")
    rows = {r["id"]: r for r in fertility.judge(df, PIECES).collect()}
    assert not rows[2]["kept"] and not rows[2]["base_failed"]
    assert rows[3]["script"] == "cyrillic" and rows[1]["script"] == "latin"


def test_bands_follow_the_input(spark):
    random.seed(2)
    known = "the story of one small house goes on with many other good words and a long way home again".split()
    rows = [(i, " ".join(random.choice(known) for _ in range(60 + i % 40))) for i in range(400)]
    odd = [(1000 + i, " ".join(random.choice(known) + "#" * (j % 2) for j in range(80))) for i in range(2)]
    kept = {r["id"]: r["kept"] for r in fertility.judge(spark.createDataFrame(rows + odd, "doc_id int, text string"), PIECES).collect()}
    assert not kept[1000] and not kept[1001]
    assert sum(kept[i] for i, _ in rows) >= 390
    # Few rows move the bands a little only.
    few = fertility.judge(spark.createDataFrame(rows[:20] + odd, "doc_id int, text string"), PIECES)
    assert few.filter("kept").count() == 22


@pytest.mark.parametrize("n", [1, 19, 200, 999])
def test_more_rows_move_a_band_further(n):
    """The band lies between the general limits and the quantiles, n / (n + PRIOR) of the way."""

    counts = {2000: n, 3000: 1}
    least, most = fertility._band(counts, (1.0, 8.0), True)
    low, high = (2.0, 3.0) if n < 99 else (2.0, 2.0)
    margin, weight = fertility.MARGIN * (high - low), (n + 1) / (n + 1 + fertility.PRIOR)
    assert least == pytest.approx(1 + weight * (low - margin - 1))
    assert most == pytest.approx(8 - weight * (8 - high - margin))


def test_verdict_equals_brute_force(spark, documents):
    """Bands from sorted values and verdicts row by row, on a whole table."""

    rows = fertility.judge(documents, PIECES).collect()
    measures = list(fertility.BANDED)
    bands = {}
    for name, general in fertility.BANDS.items():
        own = [r for r in rows if r["script"] == name and not r["base_failed"]]
        for m in measures:
            least, most = general.limits(m)
            if own:
                values = sorted(math.floor(min(r[m], fertility.MOST) * fertility.GRID + 0.5) / fertility.GRID for r in own)
                low, high = (values[max(0, math.ceil(q * len(own)) - 1)] for q in (fertility.TAIL, 1 - fertility.TAIL))
                margin, weight = fertility.MARGIN * (high - low), len(own) / (len(own) + fertility.PRIOR)
                least = max(least, least + weight * (low - margin - least))
                if fertility.BANDED[m]:
                    most = min(most, most + weight * (high + margin - most))
            bands[name, m] = least, most
    for r in rows:
        inside = all(bands[r["script"], m][0] <= r[m] <= bands[r["script"], m][1] for m in measures)
        few_bytes = r["byte_share"] <= fertility.BANDS[r["script"]].most_bytes
        assert r["kept"] == (not r["base_failed"] and inside and few_bytes)


def test_odd_rows(spark, odd):
    judged = fertility.judge(odd, PIECES, rows=True)
    rows = judged.collect()
    assert len(rows) == 8
    assert sorted(judged.select("row.*").columns) == sorted(odd.columns)
    assert [r["n_words"] for r in rows if r["id"] in (1, 2, 3)] == [0, 0, 0]
    model = zquality.Model(b"", b"", 0.0, 0.0)
    assert [r["score"] for r in zquality.score(odd, model).collect()] == [0.5] * 8
    labels = spark.createDataFrame([(6, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, 2), (3, 1, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    fitted = zquality.fit(odd, labels, F.lit(True), max_bytes=400_000)
    assert len(zquality.score(odd, fitted).collect()) == 8
    marked = toxic.fit(odd, labels, F.lit(True), max_bytes=400_000)
    scored = toxic.score(odd, marked).collect()
    assert len(scored) == 8 and all(0 <= r["score"] <= 1 for r in scored)


def test_without_labels_and_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert zquality.fit(odd, labels, F.lit(True)).offset == 0.0
    assert toxic.fit(odd, labels, F.lit(True)).slope == 0.0
    none = odd.limit(0)
    assert fertility.judge(none, PIECES).collect() == []
    assert zquality.score(none, zquality.fit(none, labels, F.lit(True))).collect() == []
    assert toxic.score(none, toxic.fit(none, labels, F.lit(True))).collect() == []
