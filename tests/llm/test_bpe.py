import random

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.CorpusEncoder(bpe.default_vocabulary())


def encoded(encoder, texts):
    return [ids for part in encoder.encode(pa.array(texts, pa.string())) for ids in part.to_pylist()]


def test_random_texts(encoder, reference):
    rng = random.Random(5)
    alphabet = "abst'rve ldmS  \n\t\r　\xa0Aß中文字0１²½,.!é́'ـन🙂​<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert encoded(encoder, texts) == reference(texts)


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", "a \n", "\n\na", "don't we'll they're I've I'd 'sabc ''s x 's", "aaaa", "abababab", "'" * 99, "<|endoftext|>", "１２３", " x"])
def test_edges(encoder, reference, text):
    assert encoded(encoder, [text]) == reference([text])


def test_very_long_pretoken(encoder, reference):
    rng = random.Random(6)
    texts = ["a" * 100_001, "".join(rng.choice("abcde") for _ in range(50_000)), "字" * 30_000]
    assert encoded(encoder, texts) == reference(texts)


def test_slices_and_reset(monkeypatch, reference):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 10)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    own = bpe.CorpusEncoder(bpe.default_vocabulary())
    texts = [f"word {k} and 词{k}" for k in range(200)]
    for _ in range(2):
        assert encoded(own, texts) == reference(texts)


def test_rank_bitmap():
    rng = random.Random(1)
    bitmap, held = bpe.RankBitmap(300_000), set()
    for _ in range(3000):
        r = rng.randrange(300_000)
        if rng.random() < 0.5:
            bitmap.add(r)
            held.add(r)
        elif held:
            r = rng.choice(sorted(held)) if rng.random() < 0.1 else min(held)
            bitmap.discard(r)
            held.discard(r)
        assert bitmap.first() == min(held, default=-1)


def test_empty_word_list():
    ids, counts = bpe.BytePairEncoder(bpe.default_vocabulary()).encode([])
    assert len(ids) == 0 and len(counts) == 0 and counts.dtype == np.int64


def test_frame(spark, reference):
    rows = [(1, "a text", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "b", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.encode_corpus(frame, "doc_id", "text").collect()))
    assert got == [(0, reference(["b"])[0]), (1, reference(["a text"])[0]), (2, []), (3, []), (3, [])]
    assert bpe.encode_corpus(frame.limit(0), "doc_id", "text").collect() == []
