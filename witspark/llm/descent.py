"""Near-duplicate vectors by NN-descent.

Only vectors with the same label (and length) are compared. Equal vectors are one
node first, so copies never meet as pairs. Each node has a sketch of 256 signs of
random projections; the bits in which two sketches differ estimate their angle, and
a cosine at the threshold leaves a bound of differing bits that a link exceeds with a
chance below 1e-10. Refining works on sketches alone; the vectors themselves are read
once to make the sketches and once to verify edges in double precision.

The graph starts from nodes whose sketches begin alike. A round joins each node's
neighbours with those nodes' own nearest neighbours, both directions counting, and
keeps the nearest `width` of what it had and found; pairs of two old edges are not
looked at again. Where a whole list lies within the bound it is saturated: there may
be more links than places. Such lists double, round after round, until they end with
a node beyond the bound, so no link is lost to a full list.

An audit compares a bounded set of nodes, the ones with the smallest hashes, with all
rows exactly. Below the wanted recall, all lists double and new starts are added.

Defined cases: vectors that are null, empty or zero or hold null or non-finite entries
and those without a label have no links and are their own component; repeated rows
and ids are separate vectors; a null id never names a component that has another,
and its row is kept only where all ids of its component are null; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from witspark.llm.common import prepare
from witspark.llm.components import connected
from witspark.plans.lineage import Rounds, broadcast_if_small, cut

#: Sketch words of 64 bits.
WORDS = 4
BITS = 64 * WORDS
#: Neighbours of a node at first.
WIDTH = 10
#: Nodes of a start block on average.
BLOCK = 64
#: Of each node's order in a block so many followers are its first neighbours.
FOLLOWERS = 4
#: Neighbours through which a saturated list grows in a round.
GUIDES = 8
#: Nodes that the audit compares with all rows.
AUDIT = 512

_SKETCH = [f"s{k}" for k in range(WORDS)]


def bit_bound(threshold: float) -> int:
    """Differing sketch bits that a pair at the threshold exceeds with a chance below 1e-10."""

    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return min(BITS, math.ceil(BITS * p + 6.5 * math.sqrt(BITS * p * (1 - p)) + 1))


def projections(d: int) -> np.ndarray:
    return np.random.default_rng(d).standard_normal((d, BITS))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square over- or underflows."""

    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows of it) of a list column; usually there is one."""

    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        yield d, np.flatnonzero(lengths == d)


def nodes_of(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row with its node, and each distinct vector of a class once.

    rows: `row`, `id`, `node` (null: links with nothing). nodes: `node`, `class`,
    `copies`, `least` (smallest id), `vector` and the sketch. Vectors meet by 96
    bits of hash within a class; two of n different ones agree by chance n * n / 2**97 times.
    """

    vector = F.col(vector_col)
    finite = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    used = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(vector, lambda c: c != 0), F.lit(False))
    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.when(used, vector).alias("vector"),
        F.when(used, F.xxhash64(F.col(label_col).cast("string"), F.size(vector))).alias("class"),
        F.when(used, F.xxhash64(vector)).alias("h1"),
        F.when(used, F.hash(vector, F.lit(1))).alias("h2"),
    )
    rows = cut(rows)
    key = ["class", "h1", "h2"]
    found = rows.filter("class IS NOT NULL").groupBy(key).agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")
    )
    named = cut(found)
    placed = rows.join(named.select(*key, "node"), key, "left").select("row", "id", "node")
    first = rows.filter("class IS NOT NULL").select(F.col("row").alias("node"), "vector")
    own = named.select("node", "class", "copies", "least").join(first, "node")
    return placed, cut(_sketched(own))


def _sketched(df: DataFrame) -> DataFrame:
    kind = _parse_datatype_string(", ".join(f"{s} bigint" for s in _SKETCH))
    for field in df.schema.fields[::-1]:
        kind.fields.insert(0, field)
        kind.names.insert(0, field.name)
    at = df.columns.index("vector")

    def work(batches):
        for batch in batches:
            words = np.zeros((batch.num_rows, WORDS), np.int64)
            for d, which in _by_length(batch.column(at)):
                x = _vectors(batch.column(at).take(pa.array(which)), d)
                signs = np.packbits(_unit(x) @ projections(d) > 0, axis=1)
                words[which] = np.ascontiguousarray(signs).view("<i8")
            columns = [pa.array(np.ascontiguousarray(words[:, k])) for k in range(WORDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=kind.names)

    return df.mapInArrow(work, kind)


def _bits(left: str, right: str) -> Column:
    """Differing bits of two sketches, given as prefixes of their columns."""

    terms = [f"bit_count({left}{s} ^ {right}{s})" for s in _SKETCH]
    return F.expr("cast(" + " + ".join(terms) + " AS int)")


def _sketch(prefix: str, to: str, of: str = "") -> list[Column]:
    return [F.col(f"{of}{prefix}{s}").alias(f"{to}{s}") for s in _SKETCH]


def starts(nodes: DataFrame, turn: int) -> DataFrame:
    """First edges, both ways: followers in blocks of nodes whose sketches begin alike.

    A block is a class and some leading bits of one sketch word, as many as leave
    `BLOCK` nodes on average; where more agree, they are dealt over several blocks
    by a hash, so a block stays small whatever the data.
    """

    word = F.col(_SKETCH[turn % WORDS])
    spun = F.expr(f"shiftleft({_SKETCH[turn % WORDS]}, {(turn // WORDS) * 16 % 64})") if turn >= WORDS else word
    sizes = nodes.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    wide = nodes.join(broadcast_if_small(sizes), "class").withColumn("spun", spun)
    prefix = F.expr(f"shiftrightunsigned(spun, cast(64 - least(24, ceil(log2(size / {BLOCK} + 1))) as int))")
    keyed = wide.select("node", "class", *_SKETCH, prefix.alias("prefix"))
    counts = keyed.groupBy("class", "prefix").agg(F.count(F.lit(1)).alias("held"))
    salt = F.expr(f"pmod(xxhash64(node, {turn}), cast(ceil(held / {2 * BLOCK}) as bigint))")
    blocks = keyed.join(counts, ["class", "prefix"]).withColumn("salt", salt)
    order = Window.partitionBy("class", "prefix", "salt").orderBy(_SKETCH[(turn + 1) % WORDS], "node")
    follower = F.struct("node", *_SKETCH)
    next_ones = F.array(*[F.lead(follower, k).over(order) for k in range(1, FOLLOWERS + 1)])
    edges = blocks.select("node", *_SKETCH, next_ones.alias("f")).select("node", *_SKETCH, F.explode("f").alias("f"))
    edges = edges.filter("f IS NOT NULL")
    return both_ways(
        edges.select("node", *_sketch("", "own_"), F.col("f.node").alias("other"), *_sketch("", "other_", "f."))
    ).withColumn("bits", _bits("own_", "other_"))


_EDGE = ["node", *(f"own_{s}" for s in _SKETCH), "other", *(f"other_{s}" for s in _SKETCH)]


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in _EDGE]
    turned = edges.select(
        F.col("other").alias("node"), *_sketch("other_", "own_"),
        F.col("node").alias("other"), *_sketch("own_", "other_"), *rest,
    )
    return edges.select(*_EDGE, *rest).unionByName(turned)


def nearest(edges: DataFrame, times: int = 1) -> DataFrame:
    """Each node's nearest distinct neighbours, `wide` * `times` of them, dealt out once by node.

    An edge that is there twice is an old one. `wide` is the same in all rows of a node.
    """

    distinct = edges.repartition("node").groupBy(*_EDGE, "bits", "wide").agg(F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("bits", F.xxhash64("other", "node"), "other"))
    return distinct.withColumn("place", place).filter(F.col("place") <= F.col("wide") * times).drop("place")


def _limits(lists: DataFrame) -> DataFrame:
    """`node`, `wide` and `worst`: a candidate must differ in fewer bits."""

    full = F.count(F.lit(1)) >= F.max("wide")
    return lists.groupBy("node").agg(
        F.max("wide").alias("wide"), F.when(full, F.max("bits")).otherwise(BITS + 1).alias("worst")
    )


def refine(lists: DataFrame, turn: int, growing: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of neighbours, where at least one of the two edges is new.

    With `growing` (`node`) only those nodes look, through `GUIDES` of their neighbours
    that change with the turn and whatever the edges' age, as the neighbours' lists
    hold much the same nodes.
    """

    limits = cut(_limits(lists))
    around = both_ways(lists.drop("wide")).join(limits.select("node", "wide"), "node")
    around = cut(nearest(around, 2))
    first = around.join(limits.select("node", "worst"), "node")
    age = "(fresh1 OR fresh2)"
    if growing is not None:
        guide = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "other", F.lit(turn))))
        first = first.join(growing, "node", "left_semi").withColumn("guide", guide).filter(F.col("guide") <= GUIDES)
        age = "true"
    left = first.select(
        "node", *_sketch("own_", "own_"), F.col("other").alias("via"), F.col("fresh").alias("fresh1"), "wide", "worst"
    )
    right = around.select(
        F.col("node").alias("via"), "other", *_sketch("other_", "other_"), F.col("fresh").alias("fresh2")
    )
    met = left.join(right, "via").filter(f"{age} AND node != other")
    found = met.withColumn("bits", _bits("own_", "other_")).filter(F.col("bits") < F.col("worst"))
    found = found.select(*_EDGE, "bits", "wide").withColumn("fresh", F.lit(True))
    return nearest(lists.withColumn("fresh", F.lit(False)).unionByName(found))


def settled(lists: DataFrame, first_turn: int, rounds: Rounds) -> DataFrame:
    """Rounds until fewer than one edge in 100 is new."""

    turn = first_turn
    while True:
        lists = rounds.keep("lists", refine(lists, turn))
        turn += 1
        edges, fresh = lists.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if fresh * 100 <= edges:
            return lists


def enlarged(lists: DataFrame, bound: int, rounds: Rounds) -> DataFrame:
    """Doubles the lists that lie within the bound as a whole until none does.

    A list that stays short of its places has no more neighbours to find.
    """

    turn = 0
    while True:
        full = cut(_limits(lists).filter(F.col("worst") <= bound).select("node"))
        if full.isEmpty():
            return lists
        # The nodes whose lists have just doubled have free places, and look.
        marked = lists.join(full.withColumn("grows", F.lit(True)), "node", "left")
        doubled = marked.withColumn("wide", F.expr("if(grows, wide * 2, wide)")).drop("grows")
        lists = rounds.keep("lists", refine(doubled, turn, full))
        turn += 1


def near_pairs(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """`a`, `b` (a < b) of the candidate edges whose cosine in double precision is at the threshold."""

    pairs = edges.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    held = nodes.select("node", "vector")
    joined = pairs.join(held.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a").join(
        held.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b"
    )
    kind = _parse_datatype_string("a bigint, b bigint")
    arrow = to_arrow_schema(kind)

    def work(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for d, which in _by_length(batch.column(2)):
                rows = pa.array(which)
                x, y = (_unit(_vectors(batch.column(c).take(rows), d)) for c in (2, 3))
                keep[which] = (x * y).sum(1) >= threshold
            own = batch.select([0, 1]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(own.columns, schema=arrow)

    return joined.select("a", "b", "va", "vb").mapInArrow(work, kind)


def audit(nodes: DataFrame, links: DataFrame, threshold: float, sample: int = AUDIT) -> tuple[int, int]:
    """(true links of the sampled nodes, those of them that are in `links`).

    The sample are the `sample` nodes with the smallest hashes; they go to every task
    and are compared with all nodes, block by block.
    """

    chosen = nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(sample).select("node", "class", "vector").collect()
    if not chosen:
        return 0, 0
    sizes: dict[int, list] = {}
    for node, class_, vector in chosen:
        sizes.setdefault(len(vector), []).append((node, class_, vector))
    asked = {
        d: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), _unit(np.array([r[2] for r in rows], float)))
        for d, rows in sizes.items()
    }
    shared = nodes.sparkSession.sparkContext.broadcast(asked)
    kind = _parse_datatype_string("a bigint, b bigint")
    arrow = to_arrow_schema(kind)

    def work(batches):
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for d, which in _by_length(batch.column(2)):
                if d not in shared.value:
                    continue
                names, classes, x = shared.value[d]
                own = batch.column(0).to_numpy()[which]
                same = batch.column(1).to_numpy()[which][:, None] == classes
                y = _unit(_vectors(batch.column(2).take(pa.array(which)), d))
                hit = np.argwhere((y @ x.T >= threshold) & same & (own[:, None] != names))
                ends = np.stack([own[hit[:, 0]], names[hit[:, 1]]], 1)
                found.append(np.stack([ends.min(1), ends.max(1)], 1))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow)

    true = cut(nodes.select("node", "class", "vector").mapInArrow(work, kind).distinct())
    return true.count(), true.join(links, ["a", "b"], "left_semi").count()


def links_of(nodes: DataFrame, threshold: float, recall: float = 0.99, width: int = WIDTH) -> DataFrame:
    """`a`, `b` of all pairs of nodes that are found and verified, with the audit as the judge."""

    bound = bit_bound(threshold)
    rounds = Rounds(nodes.sparkSession, "descent")
    begun = [starts(nodes, turn) for turn in range(WORDS)]
    turn = WORDS
    lists = None
    while True:
        edges = begun.pop()
        for more in begun:
            edges = edges.unionByName(more)
        edges = edges.withColumns({"wide": F.lit(width), "fresh": F.lit(True)})
        if lists is not None:
            edges = edges.unionByName(lists.withColumn("wide", F.greatest("wide", F.lit(width))))
            wide = edges.groupBy("node").agg(F.max("wide").alias("wide"))
            edges = edges.drop("wide").join(wide, "node")
        lists = enlarged(settled(rounds.keep("lists", nearest(edges)), turn, rounds), bound, rounds)
        links = cut(near_pairs(nodes, lists.filter(F.col("bits") <= bound), threshold))
        true, found = audit(nodes, links, threshold)
        if found >= recall * true:
            return links
        width *= 2
        begun = [starts(nodes, turn), starts(nodes, turn + 1)]
        turn += 2


def near_duplicates(
    df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: `id`, `n_links`, `component` (smallest id that it reaches), `kept`."""

    prepare(df.sparkSession)
    rows, nodes = nodes_of(df, id_col, vector_col, label_col)
    links = links_of(nodes, threshold)
    comps = connected(links)
    copies = nodes.select(F.col("node").alias("b"), F.col("copies").alias("more"))
    turned = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = turned.join(copies, "b").groupBy(F.col("a").alias("node")).agg(F.sum("more").alias("linked"))
    least = (
        comps.join(nodes.select("node", "least"), "node").groupBy("comp").agg(F.min("least").alias("component"))
    )
    named = (
        nodes.select("node", "copies", "least")
        .join(degrees, "node", "left")
        .join(comps, "node", "left")
        .join(least, "comp", "left")
        .select(
            "node",
            F.expr("copies - 1 + coalesce(linked, 0)").alias("n_links"),
            F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"),
        )
    )
    out = rows.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        "id",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
