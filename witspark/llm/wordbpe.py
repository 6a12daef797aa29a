"""Token counts with a word-end BPE, by rank-synchronous array merging.

The distinct pre-tokens of a batch lie in ragged numpy arrays: one flat array of
symbols and one of sequence numbers. In each round every sequence finds its lowest
ranked pair and all its occurrences are merged at once (from the left where they
overlap); sequences without a ranked pair leave with the symbols they have.

The vocabulary file is a `tokenizers` JSON with NFC, white space folding and lower
case before a split by pattern and bytes. Special strings inside a text are one
token each, as is the library's default.

Defined cases: a null text is empty and has no tokens; nothing is truncated or
padded; texts of any length are counted whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from witspark.llm.common import id_type, map_rows, per_worker, prepare, read_model, texts

#: Distinct pre-tokens that a worker remembers.
MEMO = 600_000
MEMO_CHARS = 64

#: White space of Unicode, which the pattern `\s` of the vocabulary file means.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable
    Latin-1, else the next free character from U+0100 on."""

    free = iter(range(256, 512))
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b if b in printable else next(free)) for b in range(256)]


class Counter:
    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        vocab = model["vocab"]
        self.size = len(vocab) + 1
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + model["end_of_word_suffix"]] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made  # made: by rank
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", SPACE)).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.memo: dict[str, int] = {}
        self.space = regex.compile(f"[{SPACE}]+")

    def ranked(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where it has none."""

        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank[at], len(self.keys))

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges; words are not empty."""

        none = len(self.keys)
        sizes = np.array([len(w) for w in words], np.int64)
        counts = sizes.copy()
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        seq = np.repeat(np.arange(len(words)), sizes)
        rank = self._pair_ranks(symbols, seq)
        while True:
            best = self._best(rank, seq, len(words))
            alive = best < none
            keep = alive[seq]
            if not keep.all():
                symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            if not len(symbols):
                return counts
            hit = rank == best[seq]
            hit = self._from_left(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            counts -= np.bincount(seq[at], minlength=len(words))
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, seq = symbols[stay], seq[stay]
            rank = self._pair_ranks(symbols, seq)

    def _pair_ranks(self, symbols, seq):
        """Rank of the pair that begins at each symbol; none at the end of a sequence."""

        out = np.full(len(symbols), len(self.keys), np.int64)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        out[inside] = self.ranked(symbols[inside] * self.size + symbols[inside + 1])
        return out

    def _best(self, rank, seq, n):
        best = np.full(n, len(self.keys), np.int64)
        if len(seq):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best[seq[starts]] = np.minimum.reduceat(rank, starts)
        return best

    @staticmethod
    def _from_left(hit):
        """Of occurrences that overlap, every second one from the left."""

        if not (hit[1:] & hit[:-1]).any():
            return hit
        at = np.arange(len(hit))
        start = hit & ~np.r_[False, hit[:-1]]
        first = np.maximum.accumulate(np.where(start, at, 0))
        return hit & ((at - first) % 2 == 0)

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case by single characters: a final sigma is as any other.
        return self.space.sub(" ", text).replace("Σ", "σ").lower()

    def counts(self, texts_: list[str]) -> list[int]:
        """Tokens of each text; the new pre-tokens of all texts are merged together."""

        parts, special = [], []
        for text in texts_:
            if self.special is not None and (found := self.special.findall(text)):
                special.append(len(found))
                parts.append([p for p in self.special.split(text) if p])
            else:
                special.append(0)
                parts.append([text])
        pieces = [[x for p in own for x in self.pieces(self.normal(p))] if len(own) != 1
                  else self.pieces(self.normal(own[0])) for own in parts]
        memo = self.memo
        new = set().union(*pieces).difference(memo) if pieces else set()
        known = memo
        if new:
            words = list(new)
            found = dict(zip(words, self.surviving([w.encode() for w in words]).tolist(), strict=True))
            short = {p: n for p, n in found.items() if len(p) <= MEMO_CHARS}
            over = len(memo) + len(short) > MEMO
            if over or len(short) < len(found):
                known = {p: memo[p] for own in pieces for p in own if p in memo} | found
            if over:
                memo.clear()
            memo.update(short)
        return [sum(map(known.__getitem__, own)) + n for own, n in zip(pieces, special, strict=True)]


def loaded(data: bytes) -> Counter:
    return per_worker(("Counter", hashlib.sha256(data).digest()), lambda: Counter(data))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, `n_bytes` (UTF-8) and `n_tokens` of each whole text; one row per input row."""

    prepare(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(read_model(path))

    def work(cols):
        body = cols["body"]
        return {
            "id": cols["id"],
            "n_bytes": [len(b) for b in body],
            "n_tokens": loaded(model.value).counts([b.decode() for b in body]),
        }

    return map_rows(
        texts(df, id_col, text_col), f"id {id_type(df, id_col)}, n_bytes bigint, n_tokens bigint", work
    )
