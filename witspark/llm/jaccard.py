"""N-gram Jaccard join with PartEnum signatures.

A document's set are its distinct word n-grams, as 64-bit hashes. Sets of equal
content are one node (a 64-bit digest of the set; two of n different sets share
one with a chance of n * n / 2**65), so copies meet before any pair is looked at.

Similar pairs are dealt to bands by the size of their smaller set; a set signs for every
band in which it may be the smaller or the larger one. With sizes of at most l and
r = floor(l / t), the pairs of a band differ in at most k = (l + r) (1 - t) / (1 + t)
elements. The feature domain is hashed into n1 partitions of three parts each. With
n1 = floor(k / 2) + 1 + spare, at least spare + 1 partitions of a similar pair
differ in at most one element; every subset of two of the three parts is
enumerated as a signature, and one of them is equal. Signatures of empty parts are
left out. That could lose a pair only where both sets have more than `spare`
partitions with an empty pair of parts; such a set signs again with another seed,
until it has not. So no link is lost.

Signatures are dealt by their leading bits; a task sorts its own and keeps those
that several nodes share, as groups. Of each group first the pairs with its
smallest node are taken, then, as components are known, those pairs of a group
whose nodes are still in different components. A parity sketch rules most out
(each differing element flips one of `SKETCH` bits, so the number of different bits
never exceeds the true difference). That many bits fill up with the differences of long
sets, so what is left of these is held against sketches that grow with the set; the rest
is verified by the exact Jaccard of the sets. Sketches are kept of all nodes in groups,
sets only of those in a pair that no sketch rules out. Groups are never expanded to
pairs within a component.

Defined cases: null, empty and blank texts have no n-grams and are linked with
nothing; with fewer words than `size` the whole sequence is one n-gram; repeated
rows and ids are linked by equal sets and give a row each; a null id never names a
component that has another.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from witspark.llm.common import id_type, map_rows, prepare, texts
from witspark.llm.components import connected
from witspark.llm.words import mix, word_hashes
from witspark.plans.lineage import broadcast_if_small, cut

#: Bytes of text for one bucket of signatures. In each bucket a batch names its nodes
#: anew, so fewer and larger buckets make a smaller shuffle.
BUCKET_BYTES = 16 << 20
#: Bytes of a signature that go through the shuffle, besides the bits of its bucket.
TAIL = 5
SKETCH = 1024
_SUBSETS = ((0, 1), (0, 2), (1, 2))


def ngram_sets(bodies: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""

    words, counts = word_hashes(bodies)
    n = len(words)
    if n >= size:
        grams = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k])
    out, at = [], 0
    for count in counts.tolist():
        if count >= size:
            out.append(np.unique(grams[at : at + count - size + 1]))
        elif count:
            whole = np.zeros(1, np.uint64)
            for k in range(count):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + words[at + k : at + k + 1])
            out.append(mix(whole + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Signed 64-bit digest of each set."""

    sums = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    xors = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(77))) if len(s) else 0 for s in sets], np.uint64)
    return mix(sums ^ mix(xors)).view(np.int64)


class Bands:
    """Bands of pairs by the size of their smaller set, and the partitions of each.

    The smaller set of band j has `low[j]` to `low[j + 1]` - 1 elements, the larger at
    most `high[j]`.
    """

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        # Wider bands are fewer to sign for, but let k grow beyond what a small set of the
        # band needs; here it is at most 1 / t ** 2 of that.
        self.step = 2 / (threshold * (1 + threshold))
        self.low, self.high, self.plans = [1], [], []

    def grow(self, most: int) -> None:
        t = self.threshold
        while self.low[-1] <= most:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.step)))
            smaller = self.low[-1] - 1
            self.high.append(int(smaller / t))
            k = int((smaller + self.high[-1]) * (1 - t) / (1 + t))
            need = k // 2 + 1
            spare = 1 + need // 8
            self.plans.append((k, need + spare, spare))

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band of sets of these sizes."""

        self.grow(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.high), sizes), np.searchsorted(np.array(self.low), sizes, "right") - 1

    def plan(self, band: int) -> tuple[int, int, int]:
        """(k, partitions, spare) of a band."""

        return self.plans[band]


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets; bands in which k is 0 need none."""

    sizes = np.array([len(s) for s in sets], np.int64)
    first, last = (x.tolist() for x in bands.of(sizes))
    out_sig, out_set = [], []
    todo = [(i, b) for i in range(len(sets)) if sizes[i] for b in range(first[i], last[i] + 1)]
    seed = 0
    while todo:
        plans = [bands.plan(b) for _, b in todo]
        todo_k = [(t, p) for t, p in zip(todo, plans) if p[0] > 0]
        if not todo_k:
            break
        index = np.array([t[0] for t, _ in todo_k])
        band = np.array([t[1] for t, _ in todo_k], np.uint64)
        parts = np.array([p[1] for _, p in todo_k], np.int64)
        spare = np.array([p[2] for _, p in todo_k], np.int64)
        lengths = sizes[index]
        values = np.concatenate([sets[i] for i in index])
        job = np.repeat(np.arange(len(index)), lengths)
        salted = mix(values + mix(np.array([seed * 7919 + 1], np.uint64)) + band[job] * np.uint64(0x9E3779B97F4A7C15))
        # The high half picks the partition, the low bits one of its three parts.
        cell = ((salted >> np.uint64(33)).astype(np.int64) % parts[job]) * 3
        cell += (salted & np.uint64(0xFFFFF)).astype(np.int64) % 3
        base = np.concatenate([[0], np.cumsum(parts)])
        cell += base[job] * 3
        total = int(base[-1]) * 3
        content = mix(values)
        low = np.bincount(cell, (content & np.uint64(0xFFFFFFFF)).astype(np.float64), total)
        high = np.bincount(cell, (content >> np.uint64(32)).astype(np.float64), total)
        count = np.bincount(cell, minlength=total).reshape(-1, 3)
        sums = mix(low.astype(np.uint64) + mix(high.astype(np.uint64) + np.uint64(5))).reshape(-1, 3)
        sums[count == 0] = 0
        owner = np.repeat(np.arange(len(index)), parts)
        name = mix(
            (np.arange(len(owner)) - base[owner]).astype(np.uint64)
            + (band[owner] << np.uint64(40))
            + np.uint64(seed << 56)
        )
        weak = np.bincount(owner, (count > 0).sum(1) < 2, len(index))
        for which, (a, b) in enumerate(_SUBSETS):
            full = (count[:, a] + count[:, b]) > 0
            value = mix(mix(sums[full, a] + name[full]) * np.uint64(3) + sums[full, b] + np.uint64(which))
            out_sig.append(value)
            out_set.append(index[owner[full]])
        again = weak > spare
        todo = [t for (t, _), more in zip(todo_k, again.tolist()) if more]
        seed += 1
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def bucket_bits(total: int) -> int:
    """Leading bits of a signature that name its bucket, for so many bytes of text."""

    return max(3, (total // BUCKET_BYTES).bit_length())


def _map_side(bits: int, size: int, threshold: Fraction):
    """Rows of one batch: its documents, and its signatures packed by bucket."""

    shift = np.uint64(64 - bits)
    bands = Bands(threshold)

    def work(cols):
        sets = ngram_sets(cols["body"], size)
        nodes = digests(sets)
        n = len(sets)
        sizes = [len(s) for s in sets]
        first: dict[int, int] = {}
        for i, node in enumerate(nodes.tolist()):
            if sizes[i]:
                first.setdefault(node, i)
        distinct = list(first.values())
        sig, which = signatures([sets[i] for i in distinct], bands) if distinct else (np.zeros(0, np.uint64),) * 2
        out = {
            "bucket": [(v * 40503 + i) % (1 << bits) for i, v in enumerate(nodes.tolist())],
            "id": list(cols["id"]),
            "n": sizes,
            "node": [v if s else None for v, s in zip(nodes.tolist(), sizes)],
            "packed": [None] * n,
        }
        if len(sig):
            order = np.argsort(sig)
            sig, which = sig[order], which[order].astype("<u2")
            bucket = (sig >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            table = nodes[distinct].astype("<i8")
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                used, local = np.unique(which[a:b], return_inverse=True)
                # 5 bytes after the bucket's bits tell signatures apart; an accidental
                # agreement only adds a pair that is verified.
                tail = (sig[a:b] << np.uint64(bits) >> np.uint64(24)).astype("<u8").view(np.uint8)
                tail = tail.reshape(-1, 8)[:, :TAIL].tobytes()
                head = np.array([len(used), b - a], "<u4").tobytes()
                blob = head + table[used].tobytes() + local.astype(_index_type(len(used))).tobytes() + tail
                out["bucket"].append(int(bucket[a]))
                out["packed"].append(blob)
            more = len(out["bucket"]) - n
            for name in ("id", "n", "node"):
                out[name] += [None] * more
        return out

    return work


def _index_type(used: int) -> str:
    """Type of a place in a blob's table of nodes; a batch of usual size needs a byte."""

    return "u1" if used <= 256 else "<u2"


def _unpack(bucket: int, blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    used, count = np.frombuffer(blob, "<u4", 2).tolist()
    at = 8
    table = np.frombuffer(blob, "<i8", used, at)
    at += 8 * used
    local = np.frombuffer(blob, _index_type(used), count, at)
    at += local.nbytes
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :TAIL] = np.frombuffer(blob, np.uint8, TAIL * count, at).reshape(-1, TAIL)
    tail = wide.reshape(-1).view("<u8")
    # The bucket goes above the 40 bits of the tail; those of one call have the same anyway.
    return tail | np.uint64((bucket & 0xFFFFFF) << 40), table[local]


def _reduce_side(id_type_: str, bits: int):
    """Passes documents on; of all signatures of the partition keeps the shared ones."""

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(f"id {id_type_}, n bigint, node bigint, gid bigint"))

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            mask = pa.compute.is_valid(batch.column("packed"))
            posts = batch.filter(mask)
            for bucket, blob in zip(posts.column("bucket").to_pylist(), posts.column("packed").to_pylist()):
                parts.setdefault(bucket, []).append(blob)
            docs = batch.filter(pa.compute.invert(mask))
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.column("id"),
                        docs.column("n"),
                        docs.column("node"),
                        pa.nulls(docs.num_rows, pa.int64()),
                    ],
                    schema=schema,
                )
        for bucket in sorted(parts):
            blobs = parts.pop(bucket)
            both = [_unpack(bucket, b, bits) for b in blobs]
            sig = np.concatenate([x for x, _ in both])
            node = np.concatenate([y for _, y in both])
            del blobs, both
            gid, member = shared(sig, node)
            for low in range(0, len(gid), 50_000):
                a, b = gid[low : low + 50_000], member[low : low + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(a), schema.field("id").type),
                        pa.nulls(len(a), pa.int64()),
                        pa.array(b),
                        pa.array(a),
                    ],
                    schema=schema,
                )

    return run


def shared(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, member) of the signatures that several nodes have; equal groups once."""

    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    # Most signatures are alone; only the others are ordered by node.
    same = sig[1:] == sig[:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    sig, node = sig[keep], node[keep]
    if not len(sig):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    sig, node = sig[fresh], node[fresh]
    begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    count = np.diff(np.r_[begin, len(sig)])
    run = np.repeat(np.arange(len(begin)), count)
    # A group's name is a hash of its members, so the same members have one name.
    hashed = mix(node.view(np.uint64))
    name = mix(np.add.reduceat(hashed, begin) + mix(count.astype(np.uint64)))
    _, first = np.unique(name, return_index=True)
    good = np.zeros(len(begin), bool)
    good[first] = True
    good &= count > 1
    chosen = good[run]
    return name.view(np.int64)[run[chosen]], node[chosen]


def _parity(values: np.ndarray, places: int) -> np.ndarray:
    """Parity of the elements at each of so many places, in bytes of eight.

    With half as many places it is the exclusive or of its two halves.
    """

    place = (mix(values ^ np.uint64(0x5BF0A8B1)) % np.uint64(places)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=places) & 1).astype(np.uint8))


def _sketch(values: np.ndarray) -> list[int]:
    """Parity of the elements at each of SKETCH places, as longs."""

    return _parity(values, SKETCH).view("<i8").tolist()


def _wide(values: np.ndarray) -> bytes | None:
    """The sketch of a long set: two to four places an element; None if SKETCH are as many."""

    places = 1 << (2 * len(values) - 1).bit_length()
    return _parity(values, places).tobytes() if places > SKETCH else None


def _least_difference(x: bytes, y: bytes) -> int:
    """Elements in which the sets of two wide sketches differ at least."""

    left, right = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(left) > len(right):
        left, right = right, left
    while len(right) > len(left):
        right = right[: len(right) // 2] ^ right[len(right) // 2 :]
    return int(np.bitwise_count(left ^ right).sum())


def _possible(threshold: Fraction) -> Column:
    """Whether sizes and sketches of `l` and `r` allow the threshold; never false for a link."""

    t, u = threshold.numerator, threshold.denominator
    differ = " + ".join(f"bit_count(l.sketch[{i}] ^ r.sketch[{i}])" for i in range(SKETCH // 64))
    return F.expr(
        f"{u} * least(l.n, r.n) >= {t} * greatest(l.n, r.n)"
        f" and ({differ}) * {u + t} <= {u - t} * (l.n + r.n)"
    )


def _unlike_left_out(pairs: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (`a`, `b`) without those of long sets that the wide sketches rule out."""

    long = sketches.filter("wide is not null")
    both = pairs.join(
        long.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("wide").alias("x")), "a", "left"
    ).join(long.select(F.col("node").alias("b"), "n", F.col("wide").alias("y")), "b", "left")
    t, u = threshold.numerator, threshold.denominator

    def work(cols):
        good = [
            x is None or y is None or _least_difference(x, y) * (u + t) <= (u - t) * (m + n)
            for m, n, x, y in zip(cols["m"], cols["n"], cols["x"], cols["y"])
        ]
        return {
            "a": [v for v, g in zip(cols["a"], good) if g],
            "b": [v for v, g in zip(cols["b"], good) if g],
        }

    return map_rows(both.select("a", "b", "m", "n", "x", "y"), "a bigint, b bigint", work)


def _verified(pairs: DataFrame, sketches: DataFrame, sets_of, threshold: Fraction) -> DataFrame:
    """The pairs (`a`, `b`) whose sets have at least the threshold as Jaccard."""

    pairs = cut(_unlike_left_out(pairs, sketches, threshold))
    # Only the sets of these pairs are made and go through the joins.
    own = cut(sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    joined = pairs.join(own.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a").join(
        own.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b"
    )
    top, bottom = threshold.numerator, threshold.denominator

    def work(cols):
        good = []
        for x, y in zip(cols["x"], cols["y"]):
            left, right = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(left, right, assume_unique=True))
            good.append(bottom * both >= top * (len(left) + len(right) - both))
        return {
            "a": [v for v, g in zip(cols["a"], good) if g],
            "b": [v for v, g in zip(cols["b"], good) if g],
        }

    return map_rows(joined.select("a", "b", "x", "y"), "a bigint, b bigint", work)


def link(
    df: DataFrame,
    size: int = 5,
    threshold: Fraction = Fraction(4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`id`, `n` (n-grams), `component` (smallest id it is linked with): one row per input row."""

    spark = df.sparkSession
    prepare(spark)
    source = texts(df, id_col, text_col)
    total = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = bucket_bits(total)
    kind = id_type(df, id_col)
    rows = map_rows(
        source,
        f"bucket bigint, id {kind}, n bigint, node bigint, packed binary",
        _map_side(bits, size, threshold),
    )
    found = cut(
        rows.repartition(1 << bits, "bucket").mapInArrow(
            _reduce_side(kind, bits), f"id {kind}, n bigint, node bigint, gid bigint"
        )
    )
    docs = found.filter("gid is null").select("id", "n", "node")
    groups = cut(found.filter("gid is not null").select("gid", "node").distinct())
    labels = _labels(source, docs, groups, size, threshold)
    named = docs.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Kept apart from the join, so that Spark can split the rows of a large component.
    least = cut(named.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("component")))
    return named.join(least, "comp", "left").select(
        "id", "n", F.coalesce("component", "id").alias("component")
    )


def _sketches(nodes: list[int], sets: list[np.ndarray]) -> dict[str, list]:
    return {
        "node": nodes,
        "n": [len(s) for s in sets],
        "sketch": [_sketch(s) for s in sets],
        "wide": [_wide(s) for s in sets],
    }


def _packed(nodes: list[int], sets: list[np.ndarray]) -> dict[str, list]:
    return {"node": nodes, "packed": [s.astype("<u8").tobytes() for s in sets]}


def _described(source: DataFrame, wanted: DataFrame, size: int, shape: str, describe) -> DataFrame:
    """What `describe` tells of the nodes `wanted` (`node`, `id` of a row with its text)."""

    named = wanted.filter("id is not null")
    body = source.join(broadcast_if_small(named), "id").select("node", "body")

    def work(cols):
        sets = ngram_sets(cols["body"], size)
        same = [i for i, (d, n) in enumerate(zip(digests(sets).tolist(), cols["node"])) if d == n]
        return describe([cols["node"][i] for i in same], [sets[i] for i in same])

    def anew(cols):
        sets = [s for s in ngram_sets(cols["body"], size) if len(s)]
        return describe(digests(sets).tolist() if sets else [], sets)

    out = map_rows(body, shape, work)
    nameless = wanted.filter("id is null").select("node")
    if nameless.isEmpty():
        return out
    # No id leads to the text of these; the rows without an id name their nodes anew.
    own = map_rows(source.filter("id is null").select("body"), shape, anew)
    own = own.join(broadcast_if_small(nameless), "node", "left_semi").dropDuplicates(["node"])
    return out.unionByName(own)


def _labels(source, docs, groups, size, threshold) -> DataFrame:
    """`node`, `comp` of all nodes that have a link."""

    # One document of each node in a group gives the set.
    wanted = cut(
        docs.join(groups.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("id"))
    )
    sketches = cut(
        _described(source, wanted, size, "node bigint, n bigint, sketch array<bigint>, wide binary", _sketches)
    )

    def sets_of(nodes: DataFrame) -> DataFrame:
        own = cut(wanted.join(broadcast_if_small(cut(nodes)), "node", "left_semi"))
        return _described(source, own, size, "node bigint, packed binary", _packed)

    stars = (
        groups.join(groups.groupBy("gid").agg(F.min("node").alias("a")), "gid")
        .filter("node != a")
        .select("a", F.col("node").alias("b"))
        .distinct()
    )
    light = sketches.select("node", "n", "sketch")
    likely = (
        stars.join(light.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("l")), "a")
        .join(light.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("r")), "b")
        .filter(_possible(threshold))
        .select("a", "b")
    )
    edges = cut(_verified(likely, sketches, sets_of, threshold).distinct())
    labels = connected(edges)
    # What is left: nodes of one group in different components.
    placed = groups.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("gid").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1")
    open_ = cut(placed.join(mixed.select("gid"), "gid").join(light, "node"))
    left, right = open_.alias("l"), open_.alias("r")
    rest = (
        left.join(
            right,
            F.expr("l.gid = r.gid and l.node < r.node and l.comp != r.comp") & _possible(threshold),
        )
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        .distinct()
    )
    more = cut(_verified(rest.join(stars, ["a", "b"], "left_anti"), sketches, sets_of, threshold).distinct())
    if more.isEmpty():
        return labels
    return connected(edges.union(more))


def one_of_each(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`df` with one row of each component: the one with the smallest id.

    Repeated rows of one id leave one; rows without an id all stay. The ids that
    go are broadcast if they are few, else the rows are joined by id.
    """

    linked = link(df, id_col=id_col, **options).filter("id is not null")
    state = cut(
        linked.groupBy("id").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("rows"))
    )
    gone = state.filter("id != component").select(F.col("id").alias(id_col))
    kept = df.join(broadcast_if_small(gone), id_col, "left_anti").select(df.columns)
    again = state.filter("id = component and rows > 1").select(F.col("id").alias(id_col))
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again)
    single = kept.join(again, id_col, "left_anti").select(df.columns)
    return single.unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(df.columns))
