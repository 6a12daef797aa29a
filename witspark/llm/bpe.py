"""Byte-level BPE: encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is
itself a token. It has levels of bit arrays: a key is placed at the first level
where it is alone at its position, and its index is the number of set bits before
it. Tier two: other pre-tokens are merged by a heap of (rank, position) over bytes
that are linked to their neighbours, lowest rank first, leftmost first.

The hash is built once on the driver from the vocabulary file (its size is
checked) and broadcast. Every distinct pre-token of a batch is looked up once;
a worker remembers up to `MEMO` of them.

Defined cases: a null text is empty and has no tokens; special tokens do not
exist, their strings are ordinary text; bytes always round-trip.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from witspark.llm.common import id_type, map_rows, per_worker, prepare, read_model, texts

#: Distinct pre-tokens, and stretches of text, that a worker remembers in each of two halves.
MEMO = 300_000

#: Remembered pre-tokens longer than this many characters would let memory grow with the texts.
MEMO_CHARS = 64

#: Fixed value: a split whose matches never go across a space that a non-space follows,
#: as every such space begins a match. What lies between two of them is split by itself.
BY_SPACE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Memory(dict):
    """What a worker remembers: when one half is full, the half before it is forgotten.

    What is asked for again moves to the young half, so that frequent words stay,
    however many rare ones pass by.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def room(self, more: int) -> None:
        if len(self) + more > self.size:
            self.old = dict(self)
            self.clear()


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Index 0..n-1 for each of n distinct 64-bit keys; -1 for nearly all others."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, before, level = keys, 0, 0
        while len(left):
            size = max(64, len(left) * 2)
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            ranks = before + np.cumsum(alone) - alone
            self.levels.append((alone, ranks.astype(np.int32), size))
            before += int(alone.sum())
            left = left[~alone[at]]
            level += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (alone, ranks, size) in enumerate(self.levels):
            if not len(todo):
                break
            at = (_mixed(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = alone[at]
            found[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return found


class Vocabulary:
    """Ranks of a rank file with one base64 token and its rank per line."""

    def __init__(self, data: bytes, pattern: str):
        pairs = [line.split() for line in data.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        keys = np.array([xxhash.xxh3_64_intdigest(t) for t in self.ranks], np.uint64)
        self.hash = PerfectHash(keys)
        order = self.hash.find(keys)
        self.at = [b""] * len(keys)
        self.rank_at = np.zeros(len(keys), np.uint32)
        for slot, (token, rank) in zip(order.tolist(), self.ranks.items(), strict=True):
            self.at[slot] = token
            self.rank_at[slot] = rank
        self.memo = Memory(MEMO)
        self.by_space = pattern == BY_SPACE
        self.stretches = Memory(MEMO)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: a heap over linked bytes.

        An entry is one number: rank, then where the left part begins, then where the
        right part ends. It is out of date if either part has changed since.
        """

        rank_of, n = self.ranks.get, len(piece)
        bits = n.bit_length()
        low, high = (1 << bits) - 1, 2 * bits
        end = list(range(1, n + 1))  # where the part that begins here ends; 0: merged away
        prior = list(range(-1, n - 1))
        heap = [
            rank << high | i << bits | i + 2
            for i in range(n - 1)
            if (rank := rank_of(piece[i : i + 2])) is not None
        ]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, stop = entry >> bits & low, entry & low
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                prior[stop] = i
                after = end[stop]
                if (rank := rank_of(piece[i:after])) is not None:
                    heappush(heap, rank << high | i << bits | after)
            k = prior[i]
            if k >= 0 and (rank := rank_of(piece[k:stop])) is not None:
                heappush(heap, rank << high | k << bits | stop)
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def learn(self, pieces) -> dict[str, bytes]:
        """Packed ids of each distinct pre-token: by the perfect hash, else by merging."""

        pieces = list(pieces)
        raw = [p.encode() for p in pieces]
        keys = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64)
        slots = self.hash.find(keys).tolist()
        out = {}
        for piece, data, slot in zip(pieces, raw, slots, strict=True):
            if slot >= 0 and self.at[slot] == data:
                out[piece] = int(self.rank_at[slot]).to_bytes(4, "little")
            else:
                out[piece] = np.array(self.merged(data), "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts_: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; what is new is learnt together."""

        if not self.by_space:
            return self._joined([self.split(t) for t in texts_])
        return self._by_stretches(texts_)

    def _joined(self, texts_: list[list[str]]) -> list[bytes]:
        """Packed ids of several texts, given as their pre-tokens."""

        ids = [list(map(self.memo.__getitem__, own)) for own in texts_]
        new = {p for own, known in zip(texts_, ids) if None in known for p, i in zip(own, known) if i is None}
        if new:
            found = self.learn(new)
            self.memo.room(len(found))
            self.memo.update((p, i) for p, i in found.items() if len(p) <= MEMO_CHARS)
            for own, known in zip(texts_, ids):
                if None in known:
                    known[:] = [found[p] if i is None else i for p, i in zip(own, known)]
        return [b"".join(known) for known in ids]

    def _by_stretches(self, texts_: list[str]) -> list[bytes]:
        """Ids by the stretches between spaces; where a space is followed by white space or by
        nothing, a text is split as a whole.

        A worker remembers the ids of whole stretches, so that a text whose words are
        known is cut at its spaces alone.
        """

        cuts = [t.split(" ") for t in texts_]
        ids = [list(map(self.stretches.__getitem__, own)) for own in cuts]
        for own in ids:
            own[0] = b""  # what stands before the first space is looked at by itself
        new = {s for own, known in zip(cuts, ids) if None in known for s, i in zip(own, known) if i is None}
        odd = {s for s in new if not s or s[0].isspace()}
        whole = {t for t, own in enumerate(cuts) if odd and not odd.isdisjoint(own[1:])}
        fresh = [s for s in new if s not in odd]
        starts = [[] if t in whole else self.split(own[0]) for t, own in enumerate(cuts)]
        rest = [self.split(texts_[t]) for t in sorted(whole)]
        learnt = self._joined([*(self.split(" " + s) for s in fresh), *starts, *rest])
        found = dict(zip(fresh, learnt))
        first = learnt[len(fresh) : len(fresh) + len(cuts)]
        out = dict(zip(sorted(whole), learnt[len(fresh) + len(cuts) :]))
        self.stretches.room(len(found))
        self.stretches.update((s, i) for s, i in found.items() if len(s) <= MEMO_CHARS)
        for t, (own, known) in enumerate(zip(cuts, ids)):
            if t not in whole:
                if None in known:
                    known = [found[s] if i is None else i for s, i in zip(own, known)]
                out[t] = first[t] + b"".join(known)
        return [out[t] for t in range(len(texts_))]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(data: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of this worker; built once per Python process."""

    return per_worker(("bpe", hashlib.sha256(data).digest(), pattern), lambda: Vocabulary(data, pattern))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id` and `ids`, the packed ids of each whole text; one row per input row."""

    prepare(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(read_model(path))

    def work(cols):
        vocabulary = loaded(model.value, pattern)
        return {"id": cols["id"], "ids": vocabulary.encode_all([b.decode() for b in cols["body"]])}

    return map_rows(texts(df, id_col, text_col), f"id {id_type(df, id_col)}, ids binary", work)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`id`, `ids` and `body`, the bytes that the ids stand for."""

    prepare(encoded.sparkSession)
    model = encoded.sparkSession.sparkContext.broadcast(read_model(path))

    def work(cols):
        vocabulary = loaded(model.value, pattern)
        return cols | {"body": [vocabulary.decode(b) for b in cols["ids"]]}

    return map_rows(
        encoded.select("id", "ids"), f"id {id_type(encoded, 'id')}, ids binary, body binary", work
    )


def _arrays(kind) -> tuple:
    """Result type, and a function from ids and packed ids to a batch of it."""

    kind = _parse_datatype_string(f"id {kind}, n_tokens bigint, ids array<int>")
    arrow = to_arrow_schema(kind)

    def batch_of(ids, packed):
        sizes = np.array([0, *(len(p) // 4 for p in packed)])
        values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes[1:]), lists.cast(arrow.field(2).type)], schema=arrow
        )

    return kind, batch_of


def unpacked(encoded: DataFrame) -> DataFrame:
    """`id`, `n_tokens` and `ids` as an array of integers."""

    kind, batch_of = _arrays(id_type(encoded, "id"))

    def run(batches):
        for batch in batches:
            yield batch_of(batch.column(0), batch.column(1).to_pylist())

    return encoded.select("id", "ids").mapInArrow(run, kind)


def encode_unpacked(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`unpacked(encode(...))` in one pass: one Python worker a task holds memory, not two."""

    prepare(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(read_model(path))
    kind, batch_of = _arrays(id_type(df, id_col))

    def run(batches):
        for batch in batches:
            vocabulary = loaded(model.value, pattern)
            yield batch_of(batch.column(0), vocabulary.encode_all([b.decode() for b in batch.column(1).to_pylist()]))

    return texts(df, id_col, text_col).mapInArrow(run, kind)
