"""Benchmark decontamination: CGK random walks, bit-sampling LSH, exact edit verification.

A leak is an item with at most `max_edit` of its length as edit distance to a part of
a document. All letters are lower-cased and white space folds to one space first.

The CGK embedding reads a text by a random walk: at step j it stands on a character,
notes it, and moves on if a random bit of (j, character) is set. Walks over two texts
that differ by few edits meet again after each edit, so that the notes agree at most
steps and edit distance becomes Hamming distance. Two walks over one text that meet at
the same step stay together. So walks from very many starts cost little more than
those from few: equal places are merged as the walks go on.

Windows have the item's size, as the walks take two steps for each of its characters.
In the documents a window begins at every `stride`-th character; in the items at every
character (of the first `REACH`), so that any place in a document stands against its own
place in the item. The steps of a walk are cut into stretches; of every stretch random
samples of steps are signatures (bit sampling, `SAMPLES` times a walk). An item is a
candidate where a stretch of the same repeat and number has the same signature. Every
repeat has its own walk and samples. Their number is the least that finds `target` of
damaged copies of the items themselves, with `max_edit` of their length as random edits,
and `MOST_REPEATS` at most. Undamaged copies are always found: a window's first stretch
ends within the item, whatever the walk.

Around a candidate's stretch, the piece of the item that holds it (at most 64
characters) is first compared with the text, many at once; it passes with at most twice
its share of the edits. Then the whole item is compared by exact edit distance (free
ends in the document), so that every row is right.

The benchmark is the query set: its signatures are sent in blocks of at most
`BLOCK_BYTES`, each a pass over the documents without a shuffle. The walks don't depend
on the number of items; only looking up their signatures does, by candidates.

Defined cases: null or empty texts and items match nothing; equal items with
different ids give a row each; an item that occurs several times in a document
gives the best of the places found (the first of equal ones); documents with the same
id and text give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from witspark.llm.common import id_type, map_rows, prepare, texts
from witspark.plans.lineage import broadcast_if_small, cut

#: Share of copies with `max_edit` random edits that the repeats must find.
TARGET = 0.97
MOST_REPEATS = 32
#: Damaged copies by which the repeats are chosen.
TRIALS = 64
#: Longest distance of windows, steps of a stretch, steps sampled from it, and samplings of a walk.
STRIDE = 32
STRETCH = 32
SAMPLE = 12
SAMPLES = 2
#: Windows of an item begin in its first characters.
REACH = 4096
#: Longest piece of an item, and pieces compared at once.
PIECE = 64
#: Characters whose windows are walked at once; bounds the memory for very long texts.
SLICE = 1 << 20
TOGETHER = 4096
#: Signatures and filter of one broadcast; characters first tried for it.
BLOCK_BYTES = 64 << 20
BLOCK_CHARS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_ONE = np.uint64(1)
#: Mark of leading bits that different signatures have.
SEVERAL = 2


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes_of(text: str) -> np.ndarray:
    wide = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return ((wide ^ (wide >> 8)) & 0xFF).astype(np.uint8)


@dataclass(frozen=True)
class Plan:
    """How the items of about one length are searched."""

    stride: int
    steps: int  # of a stretch
    stretches: int
    repeats: int = 1


def plan_of(length: int) -> tuple[int, int]:
    """Stride and steps for items of this length; the last window's first stretch fits in."""

    power = 1 << (length.bit_length() - 1)
    return STRIDE if power >= 2 * STRIDE else max(1, power // 4), max(1, min(STRETCH, power // 2))


@lru_cache(maxsize=256)
def chances(stride: int, steps: int, repeat: int, stretch: int) -> tuple:
    """Moves by step and code, weights of codes by step, first values and sampled steps of a stretch.

    The lowest bit of a weight is the move of its step, so that both are looked up at once.
    """

    random = np.random.default_rng([repeat, stretch, stride])
    moves = random.integers(0, 2, (steps, 256))
    weights = random.integers(0, 1 << 63, 256, dtype=np.uint64)
    sampled = np.zeros((SAMPLES, steps), bool)
    for own in sampled:
        own[random.permutation(steps)[:SAMPLE]] = True
    both = weights >> _ONE << _ONE | moves.astype(np.uint64)
    return moves, both, random.integers(0, 1 << 63, SAMPLES, dtype=np.uint64), sampled


def walk(codes: np.ndarray, starts: np.ndarray, plan: Plan, repeat: int) -> Iterator[tuple]:
    """(places before, places after, signatures) of every stretch and sampling of the walks from `starts`.

    `starts` ascend. Walks that have met go on as one; those at the end of the text stop.
    """

    size = len(codes)
    codes = np.append(codes, np.zeros(plan.steps, np.uint8)).astype(np.intp)
    at = np.asarray(starts, np.int64)
    for stretch in range(plan.stretches):
        at = at[: np.searchsorted(at, size)]
        if len(at) > 1:
            at = at[np.append(True, at[1:] != at[:-1])]
        if not len(at):
            return
        moves, weights, seeds, sampled = chances(plan.stride, plan.steps, repeat, stretch)
        noted = sampled.any(0).tolist()
        begin, at, values = at, at.copy(), [np.full(len(at), seed) for seed in seeds]
        seen, move, weight = (np.empty(len(at), t) for t in (np.intp, np.int64, np.uint64))
        for j in range(plan.steps):
            codes.take(at, out=seen, mode="clip")
            if noted[j]:
                weights[j].take(seen, out=weight, mode="clip")
                for value, own in zip(values, sampled):
                    if own[j]:
                        value *= _ODD
                        value += weight
                weight &= _ONE
                at += weight.view(np.int64)
            else:
                at += moves[j].take(seen, out=move, mode="clip")
        for value in values:
            value ^= value >> _SHIFT
            value *= _ODD
            yield begin, at, value


def joined(bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts with a zero behind each, where each begins, and its length."""

    sizes = np.array([len(b) for b in bodies], np.int64)
    return codes_of("".join(b + "\0" for b in bodies)), np.cumsum(sizes + 1) - sizes - 1, sizes


def windows(begins: np.ndarray, sizes: np.ndarray, stride: int) -> np.ndarray:
    """Places of the items at which their windows begin."""

    reach = np.minimum(sizes, REACH)
    first = np.cumsum(reach) - reach
    return np.repeat(begins - first, reach) + np.arange(int(reach.sum()))


def damaged(random: np.random.Generator, text: str, edits: int) -> str:
    """`text` after random substitutions, insertions and deletions of single characters."""

    letters = list(text)
    for kind, where, new in zip(*(random.integers(0, n, edits).tolist() for n in (3, 1 << 30, 1 << 30))):
        at = where % max(1, len(letters))
        letters[at : at + (kind != 1)] = [] if kind == 2 else [text[new % len(text)]]
    return "".join(letters)


def enough_repeats(plan: Plan, bodies: list[str], max_edit: float, target: float) -> int:
    """The least number of repeats that finds `target` of damaged copies of the items."""

    random = np.random.default_rng(len(bodies))
    some = [bodies[i] for i in random.permutation(len(bodies))[:TRIALS].tolist()]
    some = [some[i % len(some)] for i in range(TRIALS)]
    copies = [damaged(random, t, int(max_edit * len(t))) for t in some]
    codes, begins, sizes = joined(some)
    owner = np.repeat(np.arange(TRIALS, dtype=np.uint64), sizes + 1)
    others, _, lengths = joined(["#" * int(n) + t for n, t in zip(random.integers(0, plan.stride, TRIALS), copies)])
    holder = np.repeat(np.arange(TRIALS, dtype=np.uint64), lengths + 1)
    found = np.zeros(TRIALS, bool)
    for repeat in range(MOST_REPEATS):
        pairs = zip(
            walk(codes, windows(begins, sizes, plan.stride), plan, repeat),
            walk(others, np.arange(0, len(others), plan.stride), plan, repeat),
        )
        for (begin, end, value), (place, _, seen) in pairs:
            inside = owner[begin] == owner[np.minimum(end, len(owner) - 1)]
            mine = value[inside] ^ owner[begin[inside]]
            theirs = holder[place]
            found[theirs[np.isin(seen ^ theirs, mine)].astype(int)] = True
        if found.mean() >= target:
            return repeat + 1
    return MOST_REPEATS


@dataclass
class Index:
    """Signatures of the items' windows."""

    plans: list[Plan]
    keys: np.ndarray  # ascending
    item: np.ndarray  # by key
    place: np.ndarray  # in the item, by key
    count: np.ndarray  # equal keys, by the first of them
    maybe: np.ndarray  # by leading bits of a signature: its mark, SEVERAL, or 0 if none is there
    first: np.ndarray  # piece of each item, by item
    width: np.ndarray  # of the piece
    offset: np.ndarray  # of the piece in its item
    masks: np.ndarray  # by piece and code: bits of the places that hold it

    @property
    def shift(self) -> np.uint64:
        return np.uint64(65 - len(self.maybe).bit_length())

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.item.nbytes + self.place.nbytes + self.count.nbytes + self.maybe.nbytes + self.masks.nbytes


def pieces(items: list[tuple[object, str]]) -> tuple[np.ndarray, ...]:
    """`first`, `width`, `offset` and `masks` of an index."""

    counts = [-(-len(text) // PIECE) for _, text in items]
    masks = np.zeros((sum(counts), 256), np.uint64)
    width, offset = np.zeros(len(masks), np.int64), np.zeros(len(masks), np.int64)
    row = 0
    for (_, text), n in zip(items, counts):
        codes = codes_of(text)
        for i in range(n):
            a, b = len(codes) * i // n, len(codes) * (i + 1) // n
            np.bitwise_or.at(masks[row], codes[a:b], np.uint64(1) << np.arange(b - a, dtype=np.uint64))
            width[row], offset[row] = b - a, a
            row += 1
    return np.cumsum(counts, dtype=np.int64) - np.array(counts, np.int64), width, offset, masks


def build(items: list[tuple[object, str]], max_edit: float = 0.2, target: float = TARGET) -> Index:
    """Signatures of the normalised items (id, text)."""

    if not 0 <= max_edit < 1:
        raise ValueError("max_edit must be at least 0 and below 1")
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, (_, text) in enumerate(items):
        if text:
            kinds.setdefault(plan_of(len(text)), []).append(k)
    plans, parts = [], []
    for (stride, steps), numbers in sorted(kinds.items()):
        bodies = [items[k][1] for k in numbers]
        codes, begins, sizes = joined(bodies)
        plan = Plan(stride, steps, -(-2 * int(sizes.max()) // steps))
        plan = replace(plan, repeats=enough_repeats(plan, bodies, max_edit, target))
        plans.append(plan)
        owner = np.repeat(np.arange(len(bodies)), sizes + 1)
        starts = windows(begins, sizes, stride)
        for repeat in range(plan.repeats):
            for begin, end, value in walk(codes, starts, plan, repeat):
                own = owner[begin]
                inside = own == owner[np.minimum(end, len(owner) - 1)]
                own, begin = own[inside], begin[inside]
                parts.append((value[inside], np.array(numbers, np.int32)[own], (begin - begins[own]).astype(np.int32)))
    if not parts:
        return Index([], *(np.zeros(0, t) for t in (np.uint64, np.int32, np.int32, np.int64)), np.zeros(2, np.uint8), *pieces(items))
    keys, item, place = map(np.concatenate, zip(*parts))
    order = np.argsort(keys, kind="stable")
    maybe = np.zeros(1 << max(16, (8 * len(keys)).bit_length()), np.uint8)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.zeros(len(keys), np.int64)
    count[first] = np.diff(np.append(first, len(keys)))
    index = Index(plans, keys, item[order], place[order], count, maybe, *pieces(items))
    lead = (keys >> index.shift).astype(np.int64)
    maybe[lead] = marks(keys)
    maybe[lead[1:][(lead[1:] == lead[:-1]) & (keys[1:] != keys[:-1])]] = SEVERAL
    return index


def marks(keys: np.ndarray) -> np.ndarray:
    """Seven low bits of each signature, never 0 and never SEVERAL."""

    return keys.astype(np.uint8) | np.uint8(1)


def candidates(index: Index, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, place in the item, place in `codes`) of equal signatures."""

    for plan, low in [(p, low) for p in index.plans for low in range(0, len(codes), SLICE)]:
        starts = np.arange(low + -low % plan.stride, min(low + SLICE, len(codes)), plan.stride)
        for repeat in range(plan.repeats):
            for begin, _, value in walk(codes, starts, plan, repeat):
                mark = index.maybe.take((value >> index.shift).astype(np.int64))
                hit = np.flatnonzero((mark == marks(value)) | (mark == SEVERAL))
                first = np.searchsorted(index.keys, value[hit], "left")
                there = index.keys.take(first, mode="clip") == value[hit]
                if there.any():
                    hit, first = hit[there], first[there]
                    count = index.count[first]
                    ends = np.cumsum(count)
                    row = np.repeat(first - ends + count, count) + np.arange(ends[-1])
                    yield index.item[row], index.place[row], np.repeat(begin[hit], count)


def together(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """The same rows in parts of TOGETHER, but for the last."""

    waiting, size = [], 0
    for part in parts:
        waiting.append(part)
        size += len(part[0])
        if size >= TOGETHER:
            whole = [np.concatenate(x) for x in zip(*waiting)]
            ends = size - size % TOGETHER
            for low in range(0, ends, TOGETHER):
                yield [x[low : low + TOGETHER] for x in whole]
            waiting, size = [tuple(x[ends:] for x in whole)], size - ends
    if size:
        yield [np.concatenate(x) for x in zip(*waiting)]


def near(index: Index, codes: np.ndarray, item: np.ndarray, place: np.ndarray, at: np.ndarray, max_edit: float):
    """Which candidates' pieces are within twice their share of the edits of the text around.

    `at` of `codes` stands against `place` of `item`. Bit-parallel dynamic programming as
    in `edit_distance`, for all candidates at once. Codes fold characters, so a distance
    can only come out too small.
    """

    count = np.diff(np.append(index.first, len(index.width)))[item]
    # The piece with the middle of the stretch, which has some half as many characters as steps.
    piece = index.first[item]
    size = index.offset[piece + count - 1] + index.width[piece + count - 1]
    piece = piece + np.minimum((place + STRETCH // 4) * count // size, count - 1)
    width = index.width[piece]
    edits = np.minimum((2 * max_edit * width).astype(np.int64) + 1, width - 1)
    reach = int(edits.max())
    at = at - place + index.offset[piece] - reach
    high = np.uint64(1) << (width - 1).astype(np.uint64)
    row, masks = piece * 256, index.masks.ravel()
    plus, minus = np.full(len(piece), ~np.uint64(0)), np.zeros(len(piece), np.uint64)
    score = width.astype(np.int16)
    best, one = score.copy(), np.uint64(1)
    for _ in range(int(width.max()) + 2 * reach):
        eq = masks.take(row + codes.take(at, mode="clip"))
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus)
        down = plus & diagonal
        score += (up & high) != 0
        score -= (down & high) != 0
        np.minimum(best, score, out=best)
        up <<= one
        plus = (down << one) | ~(diagonal | up)
        minus = up & diagonal
        at += 1
    return best <= edits


def edit_distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of `pattern` to a part of `text`, and where that part ends.

    Bit-parallel dynamic programming (Myers): bit i of `plus` and `minus` says how
    row i + 1 of the current column differs from row i. None above `most`.
    """

    m = len(pattern)
    if pattern in text:
        return 0, text.index(pattern) + m
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def search(index: Index, items: list[tuple[object, str]], bodies: list[str], max_edit: float):
    """(document, item, distance, end) of the leaks; documents are normalised texts.

    `index` must be built for the same `max_edit`.
    """

    codes, begins, sizes = joined(bodies)
    length = np.array([len(text) for _, text in items])
    most = np.array([int(max_edit * n) for n in length.tolist()])
    # Places of one item in a row of characters are looked at once.
    found = [np.zeros((2, 0), np.int64)]
    for own in together(candidates(index, codes)):
        kept = near(index, codes, *own, max_edit)
        found.append(np.stack([own[0][kept], own[2][kept] - own[1][kept]]))
    parts: dict[tuple[int, int], list[list[int]]] = {}
    k, start = np.concatenate(found, axis=1)
    if len(k):
        k, start = np.unique(np.stack([k, start]), axis=1)
        low = start - most[k]
        high = start + length[k] + most[k]
        one = np.maximum(np.searchsorted(begins, low, "right") - 1, 0)
        last = np.searchsorted(begins, high, "left")
        for a, b, first, end, item in zip(*(x.tolist() for x in (low, high, one, last, k))):
            for d in range(first, end):
                a_, b_ = max(0, a - int(begins[d])), min(int(sizes[d]), b - int(begins[d]))
                if b_ - a_ >= length[item] - most[item]:
                    # Places ascend within an item, so parts do in each document.
                    own = parts.setdefault((d, item), [])
                    if own and a_ <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b_)
                    else:
                        own.append([a_, b_])
    out = []
    for (d, k), own in sorted(parts.items()):
        text, body = items[k][1], bodies[d]
        best = None
        for low, high in own:
            hit = edit_distance(text, body[low:high], int(most[k]))
            if hit and (best is None or hit[0] < best[0]):
                best = (hit[0], low + hit[1])
                if not hit[0]:
                    break
        if best:
            out.append((d, k, *best))
    return out


def blocks(rows, max_edit: float, target: float):
    """(index, normalised items) in blocks of at most BLOCK_BYTES of signatures."""

    def fit(block):
        index = build(block, max_edit, target)
        if index.nbytes <= BLOCK_BYTES or len(block) == 1:
            if index.nbytes > BLOCK_BYTES:
                raise ValueError(f"one benchmark item needs {index.nbytes} bytes of signatures")
            yield index, block
        else:
            yield from fit(block[: len(block) // 2])
            yield from fit(block[len(block) // 2 :])

    block, size = [], 0
    for row in rows:
        text = normal(row["text"])
        if size + len(text) > BLOCK_CHARS and block:
            yield from fit(block)
            block, size = [], 0
        block.append((row["item"], text))
        size += len(text)
    yield from fit(block)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    max_edit: float = 0.2,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    target: float = TARGET,
) -> DataFrame:
    """`id`, `item`, `distance`, `end` (in the normalised text): one row per document and item."""

    prepare(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    schema = (
        f"id {id_type(docs, id_col)}, item {id_type(benchmark, item_col)}, distance bigint, end bigint"
    )
    source = texts(docs, id_col, text_col)
    rows = benchmark.select(
        F.col(item_col).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")
    )

    def one_pass(shared):
        def work(cols):
            index, items = shared.value
            bodies = [normal(b.decode()) for b in cols["body"]]
            hits = search(index, items, bodies, max_edit) if index.plans else []
            return {
                "id": [cols["id"][d] for d, *_ in hits],
                "item": [items[k][0] for _, k, *_ in hits],
                "distance": [h[2] for h in hits],
                "end": [h[3] for h in hits],
            }

        return map_rows(source, schema, work)

    # All but the last block's rows are written before the next block is built.
    out = waiting = None
    for block in blocks(rows.toLocalIterator(), max_edit, target):
        if waiting is not None:
            done = cut(one_pass(waiting))
            waiting.unpersist()
            out = done if out is None else out.unionByName(done)
        waiting = context.broadcast(block)
    part = one_pass(waiting)
    return part if out is None else out.unionByName(part)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` without the documents in which an item was found; rows without an id stay."""

    found = cut(find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col("id").alias(id_col)).distinct())
    return docs.join(broadcast_if_small(found), id_col, "left_anti").select(docs.columns)
