"""Alignment of two tokenizers against a plain walk over both rows of ends."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from witspark.llm import mergepath
from witspark.llm.queries import QUERIES
from witspark.llm.wordbpe import byte_symbols

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def vocabularies():
    return mergepath.Both.load(*(open(p, "rb").read() for p in PATHS))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATHS[0])
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def walk(library, texts):
    """Per text: (links, groups text) or None, by the two libraries and one step at a time."""

    tokenizer, model = library
    value = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
    out = []
    for text in texts:
        text = text or ""
        whole = b" " + text.encode()
        a = tokenizer.encode(" " + text, add_special_tokens=False)
        b = model.encode(text)
        size_a = [len(b"".join(value[c] for c in s)) for s in a.tokens]
        said = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in zip(b, map(model.id_to_piece, b))]
        if not text or sum(size_a) != len(whole) or b"".join(said) != whole:
            out.append(None)
            continue
        i = j = at_a = at_b = 0
        links, groups, open_a, open_b = [], [], [], []
        while i < len(a.ids) or j < len(b):
            if not open_a or at_a <= at_b:
                pass
            if not open_a and not open_b:
                open_a, open_b = [a.ids[i]], [b[j]]
                at_a, at_b = at_a + size_a[i], at_b + len(said[j])
            links.append((a.ids[i], b[j]))
            if at_a == at_b:
                groups.append(",".join(map(str, open_a)) + "|" + ",".join(map(str, open_b)))
                open_a, open_b, i, j = [], [], i + 1, j + 1
            elif at_a < at_b:
                i += 1
                open_a.append(a.ids[i])
                at_a += size_a[i]
            else:
                j += 1
                open_b.append(b[j])
                at_b += len(said[j])
        out.append((len(a.ids), len(b), links, groups))
    return out


def expected(library, rows):
    walked = walk(library, [t for _, t in rows])
    counts = Counter(link for w in walked if w for link in w[2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (i, _), w in zip(rows, walked):
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        n_a, n_b, links, groups = w
        text = ";".join(groups)
        n_best = sum(counts[x] == best[x[1]] for x in links)
        total = sum(counts[x] for x in links)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append((i, n_a, n_b, len(groups), len(links), n_best, total, digest, text))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a ▁ mark of the other vocabulary"), (5, "<|endoftext|> </s> <0x41> [INST]"),
    (6, "ünïcode ✓ 漢字 \U0001f600 \x00 é"), (7, "x" * 5000), (8, "word " * 3000), (9, "\t\n  \r\n"),
    (None, "a text without an id"), (10, "the same text"), (10, "the same text"), (11, "   many   spaces   "),
]


@pytest.mark.parametrize("work, common", [(1 << 15, 1 << 20), (50, 100), (333, 0)])
def test_odd_texts(spark, library, work, common):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id bigint, text string, doc string, n int")
    got = mergepath.align(df, *PATHS, work=work, common=common, keep_groups=True).collect()
    assert sorted(map(tuple, got), key=str) == expected(library, ODD)


def test_query_equals_the_walk(spark, sf_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op13_tokenizer_alignment"](spark, sf_dir).collect()), key=str)
    assert got == [row[:-1] for row in expected(library, rows)]


def test_pieces_and_rare_pairs_change_nothing(spark, documents):
    def rows(**more):
        return sorted(map(tuple, mergepath.align(documents, *PATHS, **more).collect()))

    assert rows() == rows(work=97, common=700)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert mergepath.align(empty, *PATHS).collect() == []


@settings(deadline=None, max_examples=200)
@given(text=st.text(st.characters(codec="utf-8"), max_size=60))
def test_byte_level_equals_the_library(text):
    if not _KEPT:
        tokenizer = Tokenizer.from_file(PATHS[0])
        tokenizer.encode_special_tokens = True
        _KEPT.extend([tokenizer, mergepath.ByteLevel(open(PATHS[0], "rb").read())])
    tokenizer, own = _KEPT
    assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


_KEPT = []


@settings(deadline=None, max_examples=200)
@given(
    a=st.lists(st.integers(1, 9), min_size=1, max_size=40),
    b=st.lists(st.integers(1, 9), min_size=1, max_size=40),
    work=st.integers(1, 20),
)
def test_path_points_divide_the_merge(a, b, work):
    """Pieces follow each other, hold `work` ends (or one more at a tie) and nothing of a later one."""

    a[-1] += max(0, sum(b) - sum(a))
    b[-1] += max(0, sum(a) - sum(b))
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    points = mergepath.path_points(ends_a, ends_b, work)
    assert points[0] == (0, 0) and points[-1] == (len(a), len(b))
    for (i0, j0), (i1, j1) in zip(points, points[1:]):
        assert i0 <= i1 and j0 <= j1 and 0 < i1 - i0 + j1 - j0 <= work + 1
        last = max(ends_a[:i1].max(initial=0), ends_b[:j1].max(initial=0))
        assert (ends_a[i1:] > last).all() and (ends_b[j1:] > last).all()


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError):
        mergepath.ByteLevel(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
