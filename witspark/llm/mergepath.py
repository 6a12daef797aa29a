"""Cross-tokenizer alignment by merge-path partitioning.

Each text is encoded by two public vocabularies, A and B, whose tokens cover the
same bytes. Merging the two rising lists of token ends gives every pair of tokens
that overlap and every offset at which both end, where the text is cut into groups.

The merge is a path through the grid of A ends and B ends. Diagonal k * `work` of
the grid meets the path at one point, which a binary search finds without any
merging before it; two neighbouring points bound a piece of `work` ends that needs
nothing but its own tokens and one more of each side. Pieces are rows of a written
table, so a long text is as many equal rows, and a short one is one row. A piece
emits its overlaps, its complete groups and the open groups at its two borders;
those of pieces of one text are stitched in order.

A pair's count is its overlaps in all texts. Counting combines in each task before
the only shuffle of pairs. The most frequent pairs, at most `common` of them, are
broadcast (17 bytes each), so that no frequent pair is ever a join key; all other
pairs find their count by a join. Both ways give the same figures.

Defined cases: a text that is null or empty, or whose bytes a vocabulary does not
give back, has no tokens and one row of zeros; special tokens' strings are ordinary
text; repeated rows and ids are separate texts; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from witspark.llm.common import id_type, map_rows, per_worker, prepare, read_model, texts
from witspark.llm.wordbpe import byte_symbols
from witspark.plans.lineage import cut, shared_folder

#: Ends of both sides in a piece.
WORK = 32_768
#: Pairs that may be broadcast with their counts.
COMMON = 1 << 20
#: Distinct pairs that a task counts before it passes them on.
COUNTED = 1 << 21
#: A pair is one number: A's id above these bits, B's id below.
SHIFT = 24

#: The split of the byte-level vocabulary, which its file names only as "use_regex".
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE of a `tokenizers` JSON file.

    The ids of its merged tokens rise with the merges, so that ids are ranks and the
    faster tiktoken library gives the same tokens; another file is refused.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        value = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        step = spec["pre_tokenizer"]
        plain = (
            spec["model"]["type"] == "BPE" and spec["normalizer"] is None
            and step["type"] == "ByteLevel" and step.get("use_regex", True) and not step["add_prefix_space"]
        )
        if not plain or any(a >= b for a, b in zip(made, made[1:])) or max(map(vocab.get, value)) >= made[0]:
            raise ValueError("the vocabulary is not a plain byte-level BPE with ids in the order of its merges")
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {b"".join(value[c] for c in s): i for s, i in vocab.items() if s not in special}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.encode = tiktoken.Encoding(
            "byte-level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary


class Pieces:
    """A sentencepiece model with byte fallback; it puts a space before the text itself."""

    def __init__(self, data: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokens = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
        ]
        self.encode = lambda bodies: model.encode(bodies, num_threads=1)


class Both(NamedTuple):
    """The two vocabularies of a worker, and the byte length of each of their tokens."""

    a: ByteLevel
    b: Pieces
    size_a: np.ndarray
    size_b: np.ndarray

    @classmethod
    def load(cls, data_a: bytes, data_b: bytes) -> Both:
        a, b = ByteLevel(data_a), Pieces(data_b)
        if len(b.tokens) >= 1 << SHIFT or len(a.tokens) >= 1 << (62 - SHIFT):
            raise ValueError("a vocabulary has too many tokens")
        return cls(a, b, *(np.array([len(t) for t in v.tokens], np.int64) for v in (a, b)))


def loaded(models: tuple[bytes, bytes]) -> Both:
    key = tuple(hashlib.sha256(m).digest() for m in models)
    return per_worker(("mergepath", key), lambda: Both.load(*models))


def path_points(ends_a: np.ndarray, ends_b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Where the merge path meets each diagonal: (A ends, B ends) that come before it.

    Of equal ends A's comes first. The searches of all diagonals run side by side,
    each on its own diagonal. A point between two equal ends moves behind both, so
    that a cut never lies between pieces' halves.
    """

    n, m = len(ends_a), len(ends_b)
    diagonal = np.arange(work, n + m, work)
    low, high = np.maximum(diagonal - m, 0), np.minimum(diagonal, n)
    while (low < high).any():
        i = (low + high) // 2
        # Is A's end i among the first `diagonal` ones? It is if it does not exceed the B end it meets.
        open_ = low < high
        meets = np.where(open_, diagonal - i - 1, 0)
        before = open_ & (ends_a[np.minimum(i, n - 1)] <= ends_b[meets])
        low = np.where(before, i + 1, low)
        high = np.where(open_ & ~before, i, high)
    j = diagonal - low
    inside = (low > 0) & (j < m)
    tied = inside & (ends_a[np.maximum(low - 1, 0)] == ends_b[np.minimum(j, m - 1)])
    points = [(0, 0), *zip(low.tolist(), (j + tied).tolist()), (n, m)]
    return [p for p, before in zip(points, [None, *points]) if p != before]


class Piece(NamedTuple):
    """Own tokens of a piece and how they meet."""

    a: np.ndarray
    b: np.ndarray
    pairs: np.ndarray
    cut_a: np.ndarray  # whether each own A token ends a group
    cut_b: np.ndarray

    @classmethod
    def merge(cls, ids_a, ids_b, own_a, own_b, ahead, both: Both) -> Piece:
        """`ids_*` hold the own tokens and, where there is one, the token after them;
        `ahead` is by how many bytes B's first token begins after A's."""

        end_a = np.cumsum(both.size_a[ids_a])
        end_b = np.cumsum(both.size_b[ids_b]) + ahead
        meet_b = np.searchsorted(end_b, end_a[:own_a])  # the B token at each own A end
        meet_a = np.searchsorted(end_a, end_b[:own_b])
        cut_a = end_b[meet_b] == end_a[:own_a]
        cut_b = end_a[meet_a] == end_b[:own_b]
        # Every end is the end of one overlap; a common end counts once.
        alone = ~cut_b
        pairs = np.concatenate(
            [ids_a[:own_a] << SHIFT | ids_b[meet_b], ids_a[meet_a[alone]] << SHIFT | ids_b[:own_b][alone]]
        )
        return cls(ids_a[:own_a], ids_b[:own_b], pairs, cut_a, cut_b)


_NUMBERS: dict[int, np.ndarray] = {}


def _numbers(most: int) -> np.ndarray:
    """Decimal text of 2 * id + last, with the mark that follows it."""

    size = 1 << int(most).bit_length()
    if size not in _NUMBERS:
        _NUMBERS[size] = np.array([f"{i}{mark}".encode() for i in range(size) for mark in ",;"])
    return _NUMBERS[size]


def group_text(a, b, cut_a, cut_b) -> bytes:
    """`a1,a2|b1;a3|b2,b3;` of complete groups: both sides end with a cut."""

    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    up_to_a = np.flatnonzero(cut_a) + 1  # A tokens up to each group, itself included
    up_to_b = np.concatenate([[0], np.flatnonzero(cut_b) + 1])
    words = _numbers(int(max(a.max(), b.max())))
    laid = np.empty(len(a) + len(b), words.dtype)
    at_a = np.arange(len(a)) + up_to_b[group_a]
    laid[at_a] = words[a * 2]
    laid[np.arange(len(b)) + up_to_a[group_b]] = words[b * 2 + cut_b]
    raw = laid.view(np.uint8).reshape(len(laid), -1)
    # The last A token of a group is followed by a bar: replace its comma.
    last = at_a[cut_a]
    width = np.char.str_len(laid[last])
    raw[last, width - 1] = ord("|")
    return raw.tobytes().translate(None, b"\0")


def _listed(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def fragments(piece: Piece) -> dict[str, str]:
    """The open group before the first cut, the complete groups, and the open group behind."""

    a, b = np.flatnonzero(piece.cut_a), np.flatnonzero(piece.cut_b)
    if not len(a):
        return {"head_a": None, "head_b": None, "body": None, "rest_a": _listed(piece.a), "rest_b": _listed(piece.b)}
    ha, hb, ta, tb = a[0] + 1, b[0] + 1, a[-1] + 1, b[-1] + 1
    body = ""
    if ta > ha:
        body = group_text(piece.a[ha:ta], piece.b[hb:tb], piece.cut_a[ha:ta], piece.cut_b[hb:tb]).decode()
    return {
        "head_a": _listed(piece.a[:ha]), "head_b": _listed(piece.b[:hb]), "body": body,
        "rest_a": _listed(piece.a[ta:]), "rest_b": _listed(piece.b[tb:]),
    }


def pieces(docs: DataFrame, path_a: str, path_b: str, work: int = WORK, id_col="doc_id", text_col="text") -> DataFrame:
    """The written table of pieces: `doc` (a number of the row), `id`, `piece`, `pieces`, and the tokens.

    `a` and `b` hold packed ids with the token after the own ones; `own_a`, `own_b`
    say how many are own; `ahead` is the lead of A's first token in bytes.
    """

    spark = docs.sparkSession
    prepare(spark)
    models = spark.sparkContext.broadcast((read_model(path_a), read_model(path_b)))
    schema = (
        f"doc bigint, id {id_type(docs, id_col)}, piece int, pieces int, own_a int, own_b int,"
        " ahead bigint, a binary, b binary"
    )

    def work_on(cols):
        both = loaded(models.value)
        out = {name: [] for name in ("doc", "id", "piece", "pieces", "own_a", "own_b", "ahead", "a", "b")}

        def add(*values):
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)

        bodies = [body.decode() for body in cols["body"]]
        tokens_b = both.b.tokens
        for doc, id_, raw, text, ids_b in zip(cols["doc"], cols["id"], cols["body"], bodies, both.b.encode(bodies)):
            whole = b" " + raw
            if not raw or b"".join(map(tokens_b.__getitem__, ids_b)) != whole:
                add(doc, id_, 0, 1, 0, 0, 0, b"", b"")
                continue
            ids_a = np.array(both.a.encode(" " + text), np.int64)
            ids_b = np.array(ids_b, np.int64)
            end_a, end_b = np.cumsum(both.size_a[ids_a]), np.cumsum(both.size_b[ids_b])
            if end_a[-1] != len(whole):
                add(doc, id_, 0, 1, 0, 0, 0, b"", b"")
                continue
            points = path_points(end_a, end_b, work)
            for k, ((i0, j0), (i1, j1)) in enumerate(zip(points, points[1:])):
                ahead = int((end_b[j0 - 1] if j0 else 0) - (end_a[i0 - 1] if i0 else 0))
                a, b = ids_a[i0 : i1 + 1].astype("<u4"), ids_b[j0 : j1 + 1].astype("<u4")
                add(doc, id_, k, len(points) - 1, i1 - i0, j1 - j0, ahead, _packed(a), _packed(b))
        return out

    rows = texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("doc"))
    path = f"{shared_folder(spark)}/mergepath-{uuid.uuid4().hex}"
    map_rows(rows, schema, work_on).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _packed(ids: np.ndarray) -> bytes:
    """The ids in two bytes each where all fit, else in four; a first byte says which."""

    small = not len(ids) or ids.max() < 1 << 16
    return (b"\2" if small else b"\4") + ids.astype("<u2" if small else "<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _merged(cols, k: int, both: Both) -> Piece | None:
    """Piece k of a batch; None for a text without tokens."""

    if not cols["pieces"][k] or not cols["a"][k]:
        return None
    a, b = _unpacked(cols["a"][k]), _unpacked(cols["b"][k])
    return Piece.merge(a, b, cols["own_a"][k], cols["own_b"][k], cols["ahead"][k], both)


def pair_counts(table: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`pair`, `n` (its overlaps in all texts) and `best` (n is its B token's largest).

    The largest count of each B token is one row per token of B's vocabulary, whose
    file is bounded; that side is broadcast.
    """

    models = table.sparkSession.sparkContext.broadcast((read_model(path_a), read_model(path_b)))
    columns = ["pieces", "own_a", "own_b", "ahead", "a", "b"]
    kind = _parse_datatype_string("pair bigint, n bigint")
    arrow = to_arrow_schema(kind)

    def count(batches):
        both = loaded(models.value)
        keys, sums, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def gather():
            nonlocal keys, sums, waiting, held
            new, found = np.unique(np.concatenate([keys[:0], *waiting]), return_counts=True)
            both_keys = np.concatenate([keys, new])
            keys, where = np.unique(both_keys, return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, found]), len(keys)).astype(np.int64)
            waiting, held = [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], schema=arrow)

        for batch in batches:
            cols = {n: c.to_pylist() for n, c in zip(columns, batch.columns)}
            for k in range(batch.num_rows):
                if (piece := _merged(cols, k, both)) is not None:
                    waiting.append(piece.pairs)
                    held += len(piece.pairs)
            if held >= COUNTED:
                gather()
                if len(keys) >= COUNTED:
                    yield rows()
                    keys, sums = keys[:0], sums[:0]
        gather()
        yield rows()

    counted = table.select(columns).mapInArrow(count, kind).groupBy("pair").agg(F.sum("n").alias("n"))
    counted = cut(counted.withColumn("b", F.expr(f"pair & {(1 << SHIFT) - 1}")))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_pairs(counts: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The pairs with at least some power of two overlaps, so many that `bound` holds them; that power.

    The power is 1 where all pairs fit. It is read from one row per power.
    """

    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()
    least, held = 64, 0
    for power, n in sorted(map(tuple, sizes), reverse=True):
        if held + n > bound:
            break
        least, held = power, held + n
    else:
        least = 0
    table = counts.filter(F.col("n") >= 2**least if least < 63 else F.lit(False)).toArrow()
    order = np.argsort(keys := table["pair"].to_numpy())
    return keys[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order], least


_MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"
_TEXTS = "head_a string, head_b string, body string, rest_a string, rest_b string"


def align(
    docs: DataFrame, path_a: str, path_b: str, work: int = WORK, common: int = COMMON, keep_groups: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per text: `id`, its measures, `groups_sha256`, and with `keep_groups` the text `groups`.

    n_a, n_b: tokens; n_groups; n_links: overlapping pairs; n_best: links whose count
    is their B token's largest; count_sum: the links' counts summed up.
    """

    spark = docs.sparkSession
    table = pieces(docs, path_a, path_b, work, id_col, text_col)
    counts = cut(pair_counts(table, path_a, path_b))
    *known, least = common_pairs(counts, common)
    models = spark.sparkContext.broadcast((read_model(path_a), read_model(path_b)))
    hot = spark.sparkContext.broadcast(known)
    columns = ["doc", "id", "piece", "pieces", "own_a", "own_b", "ahead", "a", "b"]
    schema = (
        f"doc bigint, id {table.schema['id'].dataType.simpleString()}, piece int, pieces int, {_MEASURES},"
        f" groups string, groups_sha256 string, {_TEXTS}, rare array<struct<pair: bigint, m: bigint>>"
    )
    names = [f.name for f in _parse_datatype_string(schema)]

    def measure(cols):
        both, (keys, sums, best) = loaded(models.value), hot.value
        out = {n: [] for n in names}
        for k, n_pieces in enumerate(cols["pieces"]):
            row = dict.fromkeys(names) | {n: cols[n][k] for n in columns[:4]}
            row |= {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0}
            piece = _merged(cols, k, both)
            if piece is None:
                row |= {"groups": "", "groups_sha256": ""}
            else:
                pairs = piece.pairs
                row |= {"n_a": len(piece.a), "n_b": len(piece.b), "n_links": len(pairs)}
                row["n_groups"] = int(piece.cut_a.sum())
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    hit = keys[at] == pairs
                    row["count_sum"] = int(sums[at][hit].sum())
                    row["n_best"] = int(best[at][hit].sum())
                else:
                    hit = np.zeros(len(pairs), bool)
                if not hit.all():
                    rare, m = np.unique(pairs[~hit], return_counts=True)
                    row["rare"] = [{"pair": p, "m": c} for p, c in zip(rare.tolist(), m.tolist())]
                if n_pieces == 1:
                    text = group_text(piece.a, piece.b, piece.cut_a, piece.cut_b)[:-1]
                    row["groups_sha256"] = hashlib.sha256(text).hexdigest()
                    row["groups"] = text.decode() if keep_groups else None
                else:
                    row |= fragments(piece)
            for n in names:
                out[n].append(row[n])
        return out

    done = map_rows(table.select(columns), schema, measure)
    if least > 0:
        done = _with_rare(cut(done), counts)
    measures = _parse_datatype_string(_MEASURES).names
    result = ["id", *measures, "groups_sha256", *(["groups"] if keep_groups else [])]
    whole = done.filter("pieces = 1").select(*result)
    return whole.unionByName(_stitched(done.filter("pieces > 1"), measures, keep_groups).select(*result))


def _with_rare(done: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the links whose pairs were not broadcast; none of them is frequent."""

    rare = done.select("doc", "piece", F.explode("rare").alias("r")).select("doc", "piece", "r.pair", "r.m")
    more = (
        rare.join(counts, "pair")
        .groupBy("doc", "piece")
        .agg(F.sum(F.expr("m * n")).alias("more_sum"), F.sum(F.expr("if(best, m, 0)")).alias("more_best"))
    )
    return done.join(more, ["doc", "piece"], "left").withColumns(
        {
            "count_sum": F.expr("count_sum + coalesce(more_sum, 0)"),
            "n_best": F.expr("n_best + coalesce(more_best, 0)"),
        }
    )


def _stitched(parts: DataFrame, measures: list[str], keep_groups: bool) -> DataFrame:
    """One row per text of several pieces: an open group goes on into the next piece.

    A task reads its pieces sorted by text and number and holds one open group and a
    running digest; the text itself is held only with `keep_groups`.
    """

    carried = ["doc", "id", "piece", "pieces", *measures, "head_a", "head_b", "body", "rest_a", "rest_b"]
    kind = _parse_datatype_string(
        f"id {parts.schema['id'].dataType.simpleString()}, {_MEASURES}, groups_sha256 string, groups string"
    )
    arrow = to_arrow_schema(kind)

    def stitch(batches):
        digest, open_a, open_b, sums, kept, first = hashlib.sha256(), [], [], {}, [], True

        def put(text):
            nonlocal first
            text = text if first else ";" + text
            first = False
            digest.update(text.encode())
            if keep_groups:
                kept.append(text)

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    digest, open_a, open_b, kept, first = hashlib.sha256(), [], [], [], True
                    sums = dict.fromkeys(measures, 0)
                for m in measures:
                    sums[m] += row[m]
                if row["head_a"] is not None:
                    left = ",".join(filter(None, [*open_a, row["head_a"]]))
                    right = ",".join(filter(None, [*open_b, row["head_b"]]))
                    put(f"{left}|{right}")
                    if row["body"]:
                        put(row["body"][:-1])
                    open_a, open_b = [], []
                open_a.append(row["rest_a"])
                open_b.append(row["rest_b"])
                if row["piece"] == row["pieces"] - 1:
                    text = "".join(kept) if keep_groups else None
                    done.append({"id": row["id"], **sums, "groups_sha256": digest.hexdigest(), "groups": text})
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    ordered = parts.select(carried).repartition("doc").sortWithinPartitions("doc", "piece")
    return ordered.mapInArrow(stitch, kind)
