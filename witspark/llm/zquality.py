"""Compression classifier of text quality.

Two zstandard dictionaries are trained, one from texts labelled good and one from
texts labelled bad. A text is cut into blocks of `BLOCK` bytes, every block is
compressed once with each dictionary, and

    difference = (bad size - good size) / (bad size + good size)

over the whole text says which dictionary knows it better. A logistic curve
(Platt's method, with targets drawn towards 1/2) turns the difference into the
probability of label 1.

Fitting uses a bounded sample of the labelled rows: `per_class` rows of each
label with texts of at most `max_bytes`, those with the smallest hash of the id;
every second text (by digest) trains the dictionaries, the others the curve. The bound keeps what
reaches the driver below 2 * per_class * max_bytes. Scoring covers every row and
whole texts.

Defined cases: null and empty texts have the difference 0; labels that are null
or neither 0 nor 1 are not learnt from, nor are rows with more than one label;
without rows of both labels every score is the share of label 1, 0.5 without any.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame

from witspark.llm.common import id_type, labelled_sample, map_rows, per_worker, prepare, texts, whole_rows

BLOCK = 768
DICT_BYTES = 112_640
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _compressors(good: bytes, bad: bytes):
    out = []
    for data in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        out.append(
            zstandard.ZstdCompressor(
                dict_data=dictionary, write_content_size=False, write_dict_id=False
            ).compress
        )
    return out


def difference(model: Model, text: bytes) -> float:
    good, bad = per_worker(("zstd", model.good, model.bad), lambda: _compressors(model.good, model.bad))
    a = b = 0
    for start in range(0, len(text), BLOCK):
        block = text[start : start + BLOCK]
        a += len(good(block))
        b += len(bad(block))
    return (b - a) / (a + b) if a + b else 0.0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 1200,
    max_bytes: int = 20_000,
) -> Model:
    sample, shares = labelled_sample(docs, labels, use, label, per_class, max_bytes, id_col, text_col)
    prior = (shares[1] + 0.5) / (shares[0] + shares[1] + 1)
    base = float(np.log(prior / (1 - prior)))
    if not shares[0] or not shares[1]:
        return Model(b"", b"", 0.0, base)
    rows = sorted((r["label"], hashlib.sha256(r["body"]).digest(), bytes(r["body"])) for r in sample.collect())
    own = {v: [text for label_, _, text in rows if label_ == v] for v in (0, 1)}
    fitted = Model(_dictionary(own[1][::2]), _dictionary(own[0][::2]), 1.0, 0.0)
    held = {v: [difference(fitted, t) for t in (s[1::2] or s)] for v, s in own.items()}
    slope, offset = platt(held[0], held[1], prior)
    return Model(fitted.good, fitted.bad, slope, offset)


def _dictionary(samples: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK] for t in samples for i in range(0, len(t), BLOCK)]
    room = min(DICT_BYTES, max(256, sum(map(len, blocks)) // 8))
    try:
        return zstandard.train_dictionary(room, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train from: their own text is the dictionary
        return b"".join(blocks)[-DICT_BYTES:]


def platt(negative: list[float], positive: list[float], prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on weighted rows.

    Both labels weigh as `prior` has them, whatever their number in the sample.
    """

    x = np.array(negative + positive)
    n0, n1 = len(negative), len(positive)
    y = np.r_[np.full(n0, 1 / (n0 + 2)), np.full(n1, (n1 + 1) / (n1 + 2))]
    weight = np.r_[np.full(n0, (1 - prior) / n0), np.full(n1, prior / n1)] * (n0 + n1)
    scale = x.std() or 1.0
    features = np.c_[x / scale, np.ones(len(x))]
    beta = np.array([0.0, np.log(prior / (1 - prior))])

    def loss(b):
        z = features @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-3 * b[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-features @ beta))
        gradient = features.T @ (weight * (p - y)) + [1e-3 * beta[0], 0]
        hessian = (features * (weight * p * (1 - p) + 1e-9)[:, None]).T @ features
        step = np.linalg.solve(hessian + np.diag([1e-3, 1e-9]), gradient)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(step).max() * size < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def score(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rows: bool = False
) -> DataFrame:
    """`id`, `difference` and `score` (probability of label 1); one row per input row.

    With `rows` the input row is added as the struct `row`.
    """

    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(cols):
        model = shared.value
        found = [difference(model, b) if model.slope else 0.0 for b in cols["body"]]
        values = 1 / (1 + np.exp(-np.clip(model.slope * np.array(found) + model.offset, -50, 50)))
        return {"id": cols["id"], "difference": found, "score": values.tolist()}

    source = texts(df, id_col, text_col, *([whole_rows(df)] if rows else []))
    schema = f"id {id_type(df, id_col)}, difference double, score double"
    return map_rows(source, schema, work, "row" if rows else None)
