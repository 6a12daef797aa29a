"""Toxic passages by maximum-scoring segments.

Training compares the words of toxic and clean labelled texts by the number of
different neighbourhoods they stand in: a word's score is its log-odds ratio with
a Dirichlet prior. Words with a ratio below `least_odds`, or below `least_z` of its
standard deviations, say nothing. The lexicon keeps the `lexicon` most significant
words; every other word has one negative background score, set so that clean text
drifts down.

Scanning finds, in one pass per text, all maximal scoring segments: disjoint
passages of which no extension or part scores more. A segment's score S becomes
an expectation E = K n exp(-lambda S) by extreme-value statistics: lambda solves
sum p exp(lambda s) = 1 over the clean word scores, K is fitted from the maxima
of clean texts. A text's evidence is the sum of -log of the P values of its
significant segments; a logistic curve fitted on the sample gives the score.

Fitting uses a bounded sample: `per_class` labelled rows of each kind with texts
of at most `max_bytes`. Scoring covers all rows and whole texts.

Defined cases: null and empty texts have no segment; labels other than 0 and 1
and ids with two labels are not learnt from; without labels of both kinds every
score is the share of label 1.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from witspark.llm.common import id_type, labelled_sample, map_rows, prepare, texts
from witspark.llm.zquality import platt

#: A word without the punctuation around it.
EDGE = rb"!\"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"


@dataclass(frozen=True)
class Model:
    words: dict
    background: float
    rate: float  # lambda
    constant: float  # K
    slope: float
    offset: float


def tokens(text: bytes) -> list[bytes]:
    return [w.strip(EDGE) for w in text.lower().split()]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in linear time.

    Candidates are kept with the sums before and after them; a new positive score
    joins the nearest earlier candidate that begins lower, as long as the joined
    one ends higher.
    """

    total = 0.0
    starts: list[int] = []
    ends: list[int] = []
    before: list[float] = []
    after: list[float] = []
    lower: list[int] = []  # the nearest earlier candidate that begins lower
    for i, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        start, low, total = i, total, total + score
        high = total
        while True:
            j = len(starts) - 1
            while j >= 0 and before[j] >= low:
                j = lower[j]
            if j < 0 or after[j] >= high:
                starts.append(start)
                ends.append(i + 1)
                before.append(low)
                after.append(high)
                lower.append(j)
                break
            start, low = starts[j], before[j]
            del starts[j:], ends[j:], before[j:], after[j:], lower[j:]
    return [(s, e, high - low) for s, e, low, high in zip(starts, ends, before, after)]


def find(model: Model, words: list[bytes]) -> list[tuple[int, int, float]]:
    """Segments of a text; texts without a lexicon word are settled at once."""

    lexicon = model.words
    if lexicon.keys().isdisjoint(words):
        return []
    background = model.background
    return segments([lexicon.get(w, background) if w else 0.0 for w in words])


def evidence(model: Model, found: list[tuple[int, int, float]], n: int) -> float:
    """Sum over the segments of -log P, P = 1 - exp(-K n exp(-lambda S))."""

    out = 0.0
    for _, _, score in found:
        expected = model.constant * max(n, 1) * math.exp(-model.rate * score)
        p = -math.expm1(-expected)
        if p < 0.5:
            out -= math.log(max(p, 1e-300))
    return out


def _rate(scores: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda s) = 1; the mean score must be negative."""

    low, high = 0.0, 1.0
    while np.exp(high * scores).mean() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        if np.exp(middle * scores).mean() < 1:
            low = middle
        else:
            high = middle
    return high


def fit(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 1500,
    max_bytes: int = 20_000,
    lexicon: int = 20_000,
    least_z: float = 2.5,
    least_odds: float = 2.0,
    prior: float = 0.5,
) -> Model:
    sample, shares = labelled_sample(docs, labels, use, label, per_class, max_bytes, id_col, text_col)
    share = (shares[1] + 0.5) / (shares[0] + shares[1] + 1)
    base = math.log(share / (1 - share))
    if not shares[0] or not shares[1]:
        return Model({}, -1.0, 1.0, 1.0, 0.0, base)
    rows = sorted((r["label"], hashlib.sha256(r["body"]).digest(), bytes(r["body"])) for r in sample.collect())
    learn = [(v, tokens(t)) for i, (v, _, t) in enumerate(rows) if i % 3]
    tune = [(v, tokens(t)) for i, (v, _, t) in enumerate(rows) if not i % 3]
    words, background = log_odds(learn, lexicon, least_z, least_odds, prior)
    model = Model(words, background, 1.0, 1.0, 1.0, 0.0)
    clean = [t for v, t in learn if v == 0]
    scores = np.array([words.get(w, background) for t in clean for w in t if w])
    rate = _rate(scores) if len(scores) and (scores > 0).any() else 1.0
    # K n exp(-lambda S) must count the clean segments at a score that many reach.
    top = sorted(s for t in clean for _, _, s in find(model, t))
    constant = 1e-3
    if top:
        middle = top[len(top) // 2]
        above = sum(s >= middle for s in top)
        constant = above / len(scores) * math.exp(rate * middle)
    model = Model(words, background, rate, constant, 1.0, 0.0)
    held = {v: [evidence(model, find(model, t), len(t)) for u, t in tune if u == v] for v in (0, 1)}
    if not held[0] or not held[1]:
        return Model(words, background, rate, constant, 0.0, base)
    slope, offset = platt(_squashed(held[0]), _squashed(held[1]), share)
    return Model(words, background, rate, constant, slope, offset)


def _squashed(values: list[float]) -> list[float]:
    return [math.log1p(v) for v in values]


def _contexts(texts_) -> dict:
    """In how many different neighbourhoods (word before, word after) each word stands.

    Copies and near-copies of a text repeat the same neighbourhoods and count once.
    """

    seen = {c for words in texts_ for c in zip([b"", *words], words, [*words[1:], b""])}
    out: dict = {}
    for _, word, _ in seen:
        if word:
            out[word] = out.get(word, 0) + 1
    return out


def log_odds(rows, lexicon: int, least_z: float, least_odds: float, prior: float) -> tuple[dict, float]:
    """Scores of the significant words, and the background score.

    `prior` is the Dirichlet parameter of every word.
    """

    clean, toxic = (_contexts(t for v, t in rows if v == value) for value in (0, 1))
    all_words = len(clean.keys() | toxic.keys())
    none, some = (sum(own.values()) + prior * all_words for own in (clean, toxic))
    ranked = []
    for word, n in toxic.items():
        m = clean.get(word, 0)
        odds = math.log((n + prior) / max(prior, some - n - prior)) - math.log(
            (m + prior) / max(prior, none - m - prior)
        )
        z = odds / math.sqrt(1 / (n + prior) + 1 / (m + prior))
        if z >= least_z and odds >= least_odds:
            ranked.append((-z, word, odds))
    ranked.sort()
    words = {word: odds for _, word, odds in ranked[:lexicon]}
    share = sum(toxic[w] for w in words) / max(1.0, some)
    other = sum(clean.get(w, 0) for w in words) / max(1.0, none)
    background = math.log((1 - share + 1e-9) / (1 - other + 1e-9))
    return words, min(background, -0.05)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, `score`, and the passages (first word, words, segment score); one row per input row."""

    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(cols):
        model = shared.value
        scores, passages = [], []
        for body in cols["body"]:
            words = tokens(body)
            found = find(model, words)
            value = math.log1p(evidence(model, found, len(words)))
            scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, model.slope * value + model.offset)))))
            passages.append([{"at": s, "words": e - s, "score": x} for s, e, x in found])
        return {"id": cols["id"], "score": scores, "passages": passages}

    return map_rows(
        texts(df, id_col, text_col),
        f"id {id_type(df, id_col)}, score double,"
        " passages array<struct<at: bigint, words: bigint, score: double>>",
        work,
    )
