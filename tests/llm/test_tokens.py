"""Byte-level BPE and token counts against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from witspark.llm import bpe, wordbpe
from witspark.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(deadline=None, max_examples=150)
@given(text=st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=80))
def test_encoding_equals_the_library(text):
    own, theirs = _both()
    assert ids(own.encode(text)) == theirs.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


_CACHE = []


def _both():
    if not _CACHE:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        _CACHE.extend(
            [
                bpe.Vocabulary(open(RANKS, "rb").read(), public_tokenizers.PATTERN),
                tiktoken.Encoding(
                    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
                ),
            ]
        )
    return _CACHE


@pytest.mark.parametrize(
    "text", ["", "aaaa" * 500, "ab" * 2000, "<|endoftext|>", "don't we'll", "\x85a\xa0 \n\n b", "!" * 3000]
)
def test_encoding_of_odd_texts(vocabulary, library, text):
    assert ids(vocabulary.encode(text)) == library.encode_ordinary(text)


def test_memory_of_a_worker_may_overflow(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    random.seed(5)
    for _ in range(40):
        text = " ".join("".join(random.choice("abcdé") for _ in range(random.choice([3, 9, 90]))) for _ in range(12))
        assert ids(vocabulary.encode(text)) == library.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    keys = np.unique(keys)
    found = bpe.PerfectHash(keys).find(keys)
    assert sorted(found.tolist()) == list(range(len(keys)))


def test_query_op1(spark, sf_dir, texts, library):
    rows = {r["doc_id"]: r for r in QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        expected = library.encode_ordinary(text)
        packed = np.array(expected, "<u4").tobytes()
        assert rows[doc]["n_tokens"] == len(expected)
        assert rows[doc]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_unpacked_ids(spark, odd):
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    for row in bpe.unpacked(encoded).join(encoded.withColumnRenamed("ids", "packed"), "id").collect():
        assert row["ids"] == ids(row["packed"]) and row["n_tokens"] == len(row["ids"])


def test_encoded_to_arrays_in_one_pass(spark, odd):
    found = bpe.encode_unpacked(odd, RANKS, public_tokenizers.PATTERN)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    expected = bpe.unpacked(bpe.encode(odd, RANKS, public_tokenizers.PATTERN))
    assert found.schema == expected.schema
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))


def test_pipeline_encodes_in_one_pass(spark, documents, sf_dir):
    encoded = corpus_pipeline.byte_bpe(spark, documents, sf_dir)
    assert encoded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.fixture(scope="module")
def counter():
    return wordbpe.Counter(open(WORDS, "rb").read())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def counted(tokenizer, texts_):
    return [len(e.ids) for e in tokenizer.encode_batch(texts_, add_special_tokens=False)]


def test_counts_equal_the_library(counter, tokenizer):
    random.seed(3)
    letters = "abcdeéßΣçñAIÉ 0129'!,.\n\t漢かдж"
    some = ["".join(random.choice(letters) for _ in range(random.randrange(80))) for _ in range(300)]
    some += ["", "aaaa" * 300, "<|startoftext|>x<|endoftext|>", "a<|endoftext|><|endoftext|> b", "é É", "ΟΔΟΣ"]
    assert counter.counts(some) == counted(tokenizer, some)


def test_counts_with_little_memory(counter, tokenizer, monkeypatch):
    monkeypatch.setattr(wordbpe, "MEMO", 10)
    some = ["one two three", "three four " + "x" * 100, "five six one", "seven " * 20]
    for _ in range(3):
        assert counter.counts(some) == counted(tokenizer, some)


def test_query_op9(spark, sf_dir, texts, tokenizer):
    rows = {r["doc_id"]: r for r in QUERIES["op9_token_counts"](spark, sf_dir).collect()}
    expected = dict(zip(texts, counted(tokenizer, list(texts.values()))))
    assert {d: r["n_tokens"] for d, r in rows.items()} == expected
    assert all(rows[d]["n_bytes"] == len(t.encode()) for d, t in texts.items())
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows.values())


def test_odd_rows(spark, odd, library, tokenizer):
    rows = bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 8
    assert sorted(len(ids(r["ids"])) for r in rows if r["id"] in (1, 2)) == [0, 0]
    counts = wordbpe.count_tokens(odd, WORDS).collect()
    given = odd.collect()
    expected = counted(tokenizer, [r["text"] or "" for r in given])
    assert sorted((r["id"] or 0, r["n_tokens"]) for r in counts) == sorted(
        (r["doc_id"] or 0, n) for r, n in zip(given, expected)
    )


def test_empty_table(spark, odd):
    none = odd.limit(0)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).collect() == []
    assert wordbpe.count_tokens(none, WORDS).collect() == []


_SPACED = st.lists(st.sampled_from(["a", "b1", "'s", " ", "  ", "\n", "\t", "!", "é", "漢", "　", "\xa0", "\x1c", "don't"]), max_size=30)


@settings(deadline=None, max_examples=400)
@given(parts=_SPACED, times=st.integers(1, 2))
def test_cutting_at_spaces_changes_nothing(parts, times):
    """White space of all kinds around the single spaces at which a text is cut."""

    own, theirs = _both()
    assert own.by_space
    for _ in range(times):  # the second time from memory
        assert ids(own.encode("".join(parts))) == theirs.encode_ordinary("".join(parts))
        assert ids(own.encode(" ".join(parts))) == theirs.encode_ordinary(" ".join(parts))
