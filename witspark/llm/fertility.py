"""Quality rules on tokeniser fertility.

A public vocabulary with byte fallback cuts every word of a text. The document is
judged by

* characters per token: far below the band of its script the words are no words
  of a language that the vocabulary knows; far above it they repeat the few
  longest tokens;
* the share of byte-fallback tokens: characters that the vocabulary lacks;
* token entropy in bits per token, relative to what a text of so many tokens
  reaches: repeated words keep it low.

Characters per token are also measured with a second public vocabulary.

Both vocabularies cut at white space, so a text is measured by its words, whose tokens a
worker remembers.

The band depends on the script that most letters of the text belong to, and comes from
the input: of all rows that pass the base rules, the quantiles `TAIL` and 1 - `TAIL` by
script, with `MARGIN` of the distance between them on either side. Quantiles are exact on
a grid of `GRID` steps a unit, from one count per script and step, whatever order
partitions come in. Limits that hold for any language (`BANDS`) apply besides; n rows of
a script move its band from those limits by the share n / (n + `PRIOR`) of the way to the
quantiles, so that few rows say little and no number of rows is a switch. A document is
kept if it passes the base rules and all bands.

Defined cases: a null text has no words, fails the base rule and is not kept;
texts without letters use the band of `other`; repeated rows are judged each.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from witspark.llm import wordbpe
from witspark.llm.bpe import Memory
from witspark.llm.common import id_type, map_rows, per_worker, prepare, read_model, texts, whole_rows
from witspark.plans.lineage import Rounds

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"

#: Words that a worker remembers with their tokens, in each of two halves.
MEMO = 200_000
MEMO_BYTES = 96

TAIL = 0.01
MARGIN = 0.1
GRID = 1000
#: Rows of a script at which its band lies halfway between the general limits and the quantiles.
PRIOR = 200
#: Steps of the grid end here; a measure beyond counts as this.
MOST = 64.0


@dataclass(frozen=True)
class Band:
    """Limits of one script, both inclusive; entropy is relative (0 to 1)."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    #: Of the second vocabulary, which is made for one language: wider.
    least_second: float = 0.1
    most_second: float = 16.0

    def limits(self, measure: str) -> tuple[float, float]:
        return {
            "chars_per_token": (self.least_chars, self.most_chars),
            "chars_per_word_token": (self.least_second, self.most_second),
            "relative_entropy": (self.least_entropy, math.inf),
        }[measure]


#: General limits by script. Alphabets take 1 to 8 characters per token in this vocabulary,
#: syllabaries and ideographs about one.
BANDS = {
    "latin": Band(1.5, 8.0, 0.10, 0.60),
    "cyrillic": Band(1.0, 8.0, 0.15, 0.55),
    "greek": Band(0.6, 8.0, 0.60, 0.50),
    "han": Band(0.3, 3.0, 0.75, 0.45),
    "kana": Band(0.3, 3.0, 0.75, 0.45),
    "hangul": Band(0.2, 3.0, 0.90, 0.45),
    "arabic": Band(0.5, 6.0, 0.60, 0.45),
    "other": Band(0.2, 8.0, 0.95, 0.40),
}

_SCRIPT = [
    (name, regex.compile(pattern).findall)
    for name, pattern in (
        ("latin", r"\p{Latin}"),
        ("cyrillic", r"\p{Cyrillic}"),
        ("greek", r"\p{Greek}"),
        ("han", r"\p{Han}"),
        ("kana", r"[\p{Hiragana}\p{Katakana}]"),
        ("hangul", r"\p{Hangul}"),
        ("arabic", r"\p{Arabic}"),
    )
]


def script(text: str) -> str:
    """The script of most letters; the first of `BANDS` where two are equal."""

    if text.isascii():
        return "latin" if any(c.isalpha() for c in text[:64]) or regex.search("[A-Za-z]", text) else "other"
    seen = Counter(text)
    other = "".join(c for c in seen if ord(c) >= 128 or c.isalpha())
    counts = [sum(seen[c] for c in find(other)) for _, find in _SCRIPT]
    best = int(np.argmax(counts))
    return _SCRIPT[best][0] if counts[best] else "other"


class Fertility:
    def __init__(self, data: bytes, second: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.second = wordbpe.Counter(second)
        self.size = self.model.get_piece_size()
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.memo = Memory(MEMO)

    def tokens(self, texts_: list[list[bytes]]) -> list[tuple[np.ndarray, int]]:
        """Of each text (as words) the ids, and how many tokens the second vocabulary makes.

        The new words of all texts are cut together.
        """

        known = [list(map(self.memo.__getitem__, words)) for words in texts_]
        new = list({w for words, own in zip(texts_, known) if None in own for w, k in zip(words, own) if k is None})
        if new:
            # A word may hold white space of Unicode; then it has several pieces, as it should.
            said = [w.decode() for w in new]
            ids = self.model.encode(said, num_threads=1)
            counts = self.second.counts(said)
            found = {w: (np.array(i, "<u4").tobytes(), n) for w, i, n in zip(new, ids, counts, strict=True)}
            self.memo.room(len(found))
            self.memo.update((w, v) for w, v in found.items() if len(w) <= MEMO_BYTES)
            for words, own in zip(texts_, known):
                if None in own:
                    own[:] = [found[w] if k is None else k for w, k in zip(words, own)]
        return [
            (np.frombuffer(b"".join([ids for ids, _ in own]), "<u4"), sum([n for _, n in own])) for own in known
        ]

    def measures(self, ids: np.ndarray, others: int, chars: int) -> tuple[int, float, float, float, float]:
        """Tokens, characters per token, byte share, relative entropy, characters per second token."""

        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0, 0.0
        counts = np.unique(ids, return_counts=True)
        share = counts[1] / n
        entropy = float(-(share * np.log2(share)).sum())
        # Natural text of n tokens reaches about the entropy of sqrt(n) * 4 equal tokens.
        reach = math.log2(max(2.0, min(n, 4 * math.sqrt(n))))
        fallback = float(counts[1][self.bytes[counts[0]]].sum()) / n
        return n, chars / n, fallback, entropy / reach, chars / others if others else 0.0


def base(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows."""

    words = text.split()
    # Code points are the bytes that do not continue one.
    chars = len(text.decode()) - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    repeated = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    inside = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = 0  # words before this place are counted
        for i, window in enumerate(windows):
            if seen[window] > 1:
                inside += i + 3 - max(i, covered)
                covered = i + 3
    return words, chars, symbols, repeated, inside


def loaded(data: bytes, words: bytes) -> Fertility:
    key = ("Fertility", hashlib.sha256(data).digest(), hashlib.sha256(words).digest())
    return per_worker(key, lambda: Fertility(data, words))


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, script string, n_tokens bigint, chars_per_token double,"
    " byte_share double, relative_entropy double, chars_per_word_token double"
)

#: Measures that the input's own bands limit, and whether they do so above too.
BANDED = {"chars_per_token": True, "chars_per_word_token": True, "relative_entropy": False}


def derived(measured: DataFrame, general: dict[str, Band]) -> dict[str, dict[str, tuple[float, float]]]:
    """Least and most of each measure by script.

    At most GRID * MOST counts per script and measure are collected.
    """

    step = F.round(F.least(F.col("value"), F.lit(MOST)) * GRID).cast("int")
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in BANDED])
    counts = (
        measured.filter("not base_failed")
        .select("script", F.explode(each).alias("m"))
        .select("script", "m.measure", "m.value")
        .groupBy("script", "measure", step.alias("step"))
        .count()
        .collect()
    )
    steps: dict[tuple[str, str], dict[int, int]] = {}
    for name, measure, at, n in counts:
        steps.setdefault((name, measure), {})[at] = n
    return {
        name: {m: _band(steps.get((name, m), {}), band.limits(m), above) for m, above in BANDED.items()}
        for name, band in general.items()
    }


def _band(counts: dict[int, int], limits: tuple[float, float], above: bool) -> tuple[float, float]:
    """Limits of one measure: the general ones, moved towards the quantiles of its steps."""

    n = sum(counts.values())
    if not n:
        return limits
    low, high = _quantile(counts, TAIL), _quantile(counts, 1 - TAIL)
    margin = MARGIN * (high - low)
    weight = n / (n + PRIOR)
    least = max(limits[0], limits[0] + weight * (low - margin - limits[0]))
    most = min(limits[1], limits[1] + weight * (high + margin - limits[1])) if above else limits[1]
    return least, most


def _quantile(counts: dict[int, int], share: float) -> float:
    """The least step that at least this share of all rows does not exceed."""

    wanted, seen = share * sum(counts.values()), 0
    for step in sorted(counts):
        seen += counts[step]
        if seen >= wanted:
            break
    return step / GRID


def verdict(general: dict[str, Band], own: dict[str, dict[str, tuple[float, float]]]) -> Column:
    """Whether a row passes the base rules and the bands of its script."""

    out = F.lit(False)
    for name, band in general.items():
        passed = F.col("byte_share") <= band.most_bytes
        for measure, (low, high) in own[name].items():
            passed &= F.col(measure).between(low, high)
        out = F.when(F.col("script") == name, passed).otherwise(out)
    return ~F.col("base_failed") & out


def judge(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: dict[str, Band] | None = None,
    rows: bool = False,
    words_path: str | None = None,
) -> DataFrame:
    """`id`, the base measures, the fertility measures and `kept`; one row per input row.

    `words_path` is the second vocabulary (the public word-level one if None). With
    `rows` the input row is added as the struct `row`. The measured rows are written once,
    as the bands need them all before the first verdict.
    """

    prepare(df.sparkSession)
    general = BANDS | (bands or {})
    context = df.sparkSession.sparkContext
    words_path = words_path or public_tokenizers.path("word_bpe_49k.json")
    models = context.broadcast((read_model(path), read_model(words_path)))

    def work(cols):
        fertility = loaded(*models.value)
        based = [base(body) for body in cols["body"]]
        tokens = fertility.tokens([words for words, *_ in based])
        found = []
        for body, (words, chars, symbols, lines, repeats), (ids, others) in zip(cols["body"], based, tokens, strict=True):
            failed = len(words) < 50 or 100 * repeats > 50 * len(words)
            n, per, fallback, entropy, second = fertility.measures(ids, others, chars)
            found.append(
                (len(words), chars, symbols, lines, repeats, failed, script(body.decode()), n, per, fallback, entropy, second)
            )
        names = [part.split()[0] for part in SCHEMA.split(",")]
        columns = list(zip(*found)) or [()] * len(names)
        return {"id": cols["id"]} | {n: list(c) for n, c in zip(names, columns, strict=True)}

    shape = f"id {id_type(df, id_col)}, {SCHEMA}"
    more = [whole_rows(df)] if rows else []
    measured = map_rows(texts(df, id_col, text_col, *more), shape, work, "row" if rows else None)
    measured = Rounds(df.sparkSession, "fertility").keep("measured", measured)
    return measured.withColumn("kept", verdict(general, derived(measured, general)))
