"""Jaccard join and decontamination against brute force."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from witspark.llm import components, jaccard, leaks
from witspark.llm.queries import QUERIES


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in docs}


def test_query_op5(spark, sf_dir, texts):
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_ngram_jaccard"](spark, sf_dir).collect()}
    assert rows == brute_components(texts)


def edited(random_, words, rate):
    out = []
    for w in words:
        draw = random_.random()
        if draw < rate / 3:
            continue
        out.append(f"w{random_.randrange(10**6)}" if draw < rate else w)
        if rate < draw < rate * 4 / 3:
            out.append("new")
    return out


def test_families_of_copies_at_all_sizes(spark):
    """Chains and families around the threshold, from one word to some thousands."""

    random_ = random.Random(8)
    texts = {}
    for family, size in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 21, 26, 40, 80, 200, 900, 3000]):
        words = [f"w{random_.randrange(10**6)}" for _ in range(size)]
        texts[len(texts)] = " ".join(words)
        for _ in range(8 if size < 900 else 4):
            rate = random_.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.05])
            words_ = edited(random_, words, rate)
            texts[len(texts)] = " ".join(words_)
            if random_.random() < 0.5:
                words = words_
    passage = " ".join(f"p{i}" for i in range(55))
    for i in range(30):
        own = [f"q{random_.randrange(10**6)}" for _ in range(random_.randrange(20, 120))]
        texts[len(texts)] = " ".join(own[:10] + [passage] + own[10:])
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    rows = {r["id"]: (r["n"], r["component"]) for r in jaccard.link(df).collect()}
    assert rows == brute_components(texts)


def test_similar_sets_always_share_a_signature():
    """PartEnum loses nothing: pairs exactly at the threshold, sizes 4 to 3000."""

    rng = np.random.default_rng(5)
    bands = jaccard.Bands(Fraction(4, 5))
    for _ in range(300):
        both = int(rng.integers(4, 60) if rng.random() < 0.7 else rng.integers(60, 2400))
        differ = both // 4  # |A and B| / |A or B| = both / (both + differ) >= 4/5
        split = int(rng.integers(0, differ + 1))
        values = rng.integers(0, 1 << 62, both + differ).astype(np.uint64)
        a = np.unique(np.r_[values[:both], values[both : both + split]])
        b = np.unique(np.r_[values[:both], values[both + split :]])
        if np.array_equal(a, b):
            continue
        sig, which = jaccard.signatures([a, b], bands)
        assert set(sig[which == 0].tolist()) & set(sig[which == 1].tolist()), (len(a), len(b))


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(100):
        values = rng.integers(0, 1 << 62, 500).astype(np.uint64)
        a, b = values[: int(rng.integers(1, 400))], values[int(rng.integers(0, 300)) :]
        x, y = (np.array(jaccard._sketch(v), "<i8") for v in (a, b))
        flips = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        assert flips <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_by_brute_force(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(random.randrange(100, 200), random.randrange(100, 200)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in components.connected(df).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert got.keys() == near.keys()


def test_join_of_odd_rows(spark, odd):
    rows = jaccard.link(odd).collect()
    assert len(rows) == 8
    by = defaultdict(list)
    for r in rows:
        by[r["id"]].append((r["n"], r["component"]))
    assert by[1] == by[2] or all(n == 0 for n, _ in by[1] + by[2] + by[3])
    assert {c for _, c in by[6]} == {6} and len(by[6]) == 2
    assert by[4] == [(1, 4)] and by[5] == [(1, 5)]
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert jaccard.link(odd.limit(0)).collect() == []
    assert jaccard.one_of_each(odd.limit(0)).collect() == []


def brute_edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance_by_brute_force():
    random.seed(9)
    for _ in range(300):
        pattern = "".join(random.choice("abc ") for _ in range(random.randrange(1, 12)))
        text = "".join(random.choice("abc ") for _ in range(random.randrange(20)))
        expected, most = brute_edit(pattern, text), random.randrange(8)
        got = leaks.edit_distance(pattern, text, most)
        assert (got is None) == (expected > most) and (got is None or got[0] == expected)


def test_few_foreign_signatures_are_looked_up():
    random_ = random.Random(4)
    items = [(k, "".join(random_.choice("abcdefgh ") for _ in range(200))) for k in range(40)]
    index = leaks.build(items)
    values = np.random.default_rng(5).integers(0, 1 << 64, 50_000, dtype=np.uint64)
    own = np.concatenate([values, index.keys])
    mark = index.maybe.take((own >> index.shift).astype(np.int64))
    passed = (mark == leaks.marks(own)) | (mark == leaks.SEVERAL)
    assert passed[len(values) :].all() and passed[: len(values)].mean() < 0.03
    run = np.flatnonzero(index.count)
    assert index.count.sum() == len(index.keys) and (index.keys[run][1:] > index.keys[run][:-1]).all()


def test_query_op10(spark, sf_dir, texts):
    items = {r["item_id"]: leaks.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for n in [leaks.normal(t)] for i, x in items.items() if x in n}
    rows = QUERIES["op10_decontamination"](spark, sf_dir).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert exact <= found and len(found) == len(rows) and exact
    for r in rows:
        assert brute_edit(items[r["item_id"]], leaks.normal(texts[r["doc_id"]])) == r["distance"]


@pytest.mark.parametrize("rows, per_signature", [(256, 6), (400, 7)])
def test_signatures_are_packed_small_and_read_back(rows, per_signature):
    random_ = random.Random(6)
    bodies = [" ".join(str(random_.randrange(10**6)) for _ in range(60)).encode() for _ in range(rows)]
    out = jaccard._map_side(3, 5, Fraction(4, 5))({"id": list(range(rows)), "body": bodies})
    sets = jaccard.ngram_sets(bodies, 5)
    sig, which = jaccard.signatures(sets, jaccard.Bands(Fraction(4, 5)))
    nodes = jaccard.digests(sets)[which]
    expected = {(int(s) >> 61, int(s) << 3 >> 24 & (1 << 40) - 1, n) for s, n in zip(sig.tolist(), nodes.tolist())}
    found, held = set(), 0
    for bucket, blob in zip(out["bucket"], out["packed"]):
        if blob is not None:
            held += len(blob) - 8 - 8 * int(np.frombuffer(blob, "<u4", 1)[0])
            values, own = jaccard._unpack(bucket, blob, 3)
            found |= {(bucket, v & (1 << 40) - 1, n) for v, n in zip(values.tolist(), own.tolist())}
    assert found == expected and held == per_signature * len(sig)


def test_nodes_are_named_in_few_buckets():
    # At 30 GB a batch names its nodes once for each of 2,048 buckets, not of 4,096.
    assert jaccard.bucket_bits(30 * 10**9) <= 11
    random_ = random.Random(7)
    bodies = [" ".join(str(random_.randrange(10**6)) for _ in range(60)).encode() for _ in range(256)]
    cols = {"id": list(range(256)), "body": bodies}
    held = [
        sum(len(b) for b in jaccard._map_side(bits, 5, Fraction(4, 5))(cols)["packed"] if b)
        for bits in (jaccard.bucket_bits(30 * 10**9), 12)
    ]
    assert held[0] < held[1]


@pytest.mark.parametrize("rate, least", [(0.02, 0.97), (0.05, 0.95), (0.1, 0.85)])
def test_recall_of_edited_items(spark, sf_dir, rate, least):
    random_ = random.Random(3)
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    items = [(r["item_id"], leaks.normal(r["text"])) for r in rows]
    index = leaks.build(items)
    hits = total = 0
    for k, (_, text) in enumerate(items * 4):
        letters = []
        for c in text:
            if random_.random() < rate:
                letters.append(random_.choice(["", "x", c + "e"]))
            else:
                letters.append(c)
        body = "some words stand before " + "".join(letters) + " and some stand behind it"
        total += 1
        hits += any(h[1] == k % len(items) for h in leaks.search(index, items, [body], 0.2))
    assert hits / total >= least


def damaged(random_, text, edits):
    """`text` after random edits of single characters."""

    letters = list(text)
    for _ in range(edits):
        at, c = random_.randrange(len(letters)), random_.choice("abcxyz ")
        letters[at : at + random_.randrange(2)] = random_.choice([[c], []])
    return "".join(letters)


def test_recall_against_brute_force(spark, sf_dir, texts):
    """Copies with up to 20% edits, even damage, and items of all lengths, against every pair compared."""

    random_ = random.Random(5)
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    items = [(k, leaks.normal(r["text"])) for k, r in enumerate(rows)]
    items += [(len(items) + n, items[n % 40][1][:n].strip()) for n in (9, 14, 20, 31, 32, 33, 63, 64, 65, 66)]
    bodies = []
    for _, text in items:
        bodies += [f"some w{damaged(random_, text, int(r * len(text)))}ords" for r in (0.05, 0.1, 0.15, 0.2)]
        even = "".join("#" if i % 6 == 3 else c for i, c in enumerate(text))
        bodies += [even, f"xx{even}", text]
    bodies += [leaks.normal(t) for t in list(texts.values())[:10]]
    for max_edit in (0.2, 0.05):
        index = leaks.build(items, max_edit)
        found = {(d, k): n for d, k, n, _ in leaks.search(index, items, bodies, max_edit)}
        expected = {}
        for d, body in enumerate(bodies):
            for k, (_, text) in enumerate(items):
                hit = leaks.edit_distance(text, body, int(max_edit * len(text)))
                if hit:
                    expected[d, k] = hit[0]
        assert set(found) <= set(expected)
        for least, edits in ((1, 0), (0.9, 0.05), (0.9, 0.1), (0.9, 0.15), (0.9, 0.2)):
            own = [k for k, n in expected.items() if edits - 0.05 < n / len(items[k[1]][1]) <= edits]
            assert sum(k in found for k in own) >= least * len(own)
        assert len(expected) > (4 if max_edit == 0.2 else 1) * 40


def test_copies_are_found_at_any_length_and_place():
    random_ = random.Random(9)
    for n in (1, 2, 3, 5, 8, 15, 16, 17, 40, 63, 64, 130, 700):
        item = "".join(random_.choice("abcdefgh") for _ in range(n))
        bodies = ["z" * i + item + "z" * (i % 3) for i in range(40)]
        index = leaks.build([("x", item)])
        hits = leaks.search(index, [("x", item)], bodies, 0.2)
        assert [(h[0], h[2]) for h in hits] == [(d, 0) for d in range(40)]


def test_walks_that_meet_stay_together():
    """Merged walks give what each start gives alone."""

    random_ = np.random.default_rng(2)
    codes = random_.integers(97, 101, 400).astype(np.uint8)
    plan = leaks.Plan(1, 16, 12, 1)
    merged = [dict(zip(b.tolist(), zip(e.tolist(), v.tolist()))) for b, e, v in leaks.walk(codes, np.arange(400), plan, 3)]
    for start in range(0, 400, 7):
        for stretch, (b, e, v) in enumerate(leaks.walk(codes, np.array([start]), plan, 3)):
            assert merged[stretch][int(b[0])] == (int(e[0]), int(v[0]))
    assert len(merged[-1]) < len(merged[0]) / 2


def test_blocks_are_bounded_in_bytes(monkeypatch):
    items = [{"item": k, "text": f"item {k} " + "some words of it " * 8} for k in range(60)]
    whole = [text for _, block in leaks.blocks(iter(items), 0.2, 0.9) for text in block]
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 300_000)
    parts = list(leaks.blocks(iter(items), 0.2, 0.9))
    assert len(parts) > 1 and [t for _, block in parts for t in block] == whole
    assert all(index.nbytes <= 300_000 for index, _ in parts)


def test_leaks_of_odd_rows(spark, odd):
    items = spark.createDataFrame(
        [(1, "some words without an id, said twice"), (2, None), (3, ""), (4, "the SAME  row"), (None, "as it is")],
        "item_id int, text string",
    )
    rows = leaks.find_leaks(odd, items).collect()
    assert sorted((str(r["id"]), str(r["item"])) for r in rows) == sorted(
        [("None", "1"), ("6", "4"), ("6", "4"), ("6", "None"), ("6", "None")]
    )
    assert leaks.find_leaks(odd.limit(0), items).collect() == []
    assert leaks.find_leaks(odd, items.limit(0)).collect() == []
    kept = leaks.without_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == 6


def test_a_text_without_an_id_links_others(spark):
    """Two documents are alike only through a third, which has no id."""

    words = [f"w{i}" for i in range(100)]
    last = " ".join(words[:90] + [f"x{i}" for i in range(10)])
    first = " ".join([f"y{i}" for i in range(10)] + words[10:])
    rows = [(5, last), (7, first), (None, " ".join(words)), (None, "alone without an id and unlike all others"), (9, "q")]
    found = jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r["id"], r["component"]) for r in found), key=str) == [(5, 5), (7, 5), (9, 9), (None, 5), (None, None)]


def test_bands_hold_every_similar_pair_with_few_signatures():
    """Any two sizes within the threshold share a band whose k covers them."""

    t = Fraction(4, 5)
    bands = jaccard.Bands(t)
    sizes = np.arange(1, 1500)
    first, last = bands.of(sizes)
    for small in range(1, 1000):
        for large in {small, small * 9 // 8, int(small / t)}:
            shared = range(max(first[small - 1], first[large - 1]), min(last[small - 1], last[large - 1]) + 1)
            most = int((small + large) * (1 - t) / (1 + t))
            assert any(bands.plan(band)[0] >= most for band in shared), (small, large)
    signed = sum(bands.plan(band)[0] for a, b in zip(first, last) for band in range(a, b + 1))
    # Bands of one ratio l / t, each set signing for two, came to 0.56 an element.
    assert signed < 0.48 * sizes.sum()


def test_wide_sketches_rule_out_long_sets_and_never_a_link():
    rng = np.random.default_rng(8)
    for both, differ in [(4000, 4000), (4000, 1000), (20_000, 20_000), (1100, 1), (520, 130), (1000, 30)]:
        values = rng.integers(0, 1 << 62, both + differ).astype(np.uint64)
        a, b = values[: both + differ // 2], np.r_[values[:both], values[both + differ // 2 :]]
        if (both, differ) == (1000, 30):
            a, b = values, values[:1000]  # 4,096 places and 2,048
        least = jaccard._least_difference(jaccard._wide(a), jaccard._wide(b))
        assert least <= len(np.setxor1d(a, b))
        alike = 5 * both >= 4 * (both + differ)
        assert alike or least * 9 > len(a) + len(b)
    assert jaccard._wide(values[:512]) is None and len(jaccard._wide(values[:513])) == 256


def test_pairs_that_wide_sketches_rule_out_are_left_out(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    sets = [base, np.r_[base[:4900], rng.integers(0, 1 << 62, 100).astype(np.uint64)]]
    sets += [np.r_[base[:2000], rng.integers(0, 1 << 62, 3000).astype(np.uint64)], base[:300], base[:310]]
    told = jaccard._sketches(list(range(5)), sets)
    sketches = spark.createDataFrame(
        list(zip(*told.values())), "node bigint, n bigint, sketch array<bigint>, wide binary"
    )
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(a + 1, 5)], "a bigint, b bigint")
    # The narrow sketch allows the long pairs that are unlike, as its places are full.
    narrow = np.array(told["sketch"], "<i8")
    assert np.bitwise_count((narrow[0] ^ narrow[2]).view("<u8")).sum() * 9 <= 10_000
    left = {(r["a"], r["b"]) for r in jaccard._unlike_left_out(pairs, sketches, Fraction(4, 5)).collect()}
    assert left == {(0, 1), (3, 4)} | {(a, b) for a in range(3) for b in (3, 4)}
