import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing as P

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")

OWN = Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\xa0 ab'sé1.,<|>"), st.characters(codec="utf-8")), max_size=60))
def test_encoder_equals_the_tokenizer(text):
    assert P.encoder(VOCABULARY, RANKS).encode(text) == ids_of(OWN, text).tobytes()


def test_encoder_knows_special_tokens(tokenizer):
    text = "a <|endoftext|> b  c \n d"
    assert P.encoder(VOCABULARY, RANKS).encode(text) == ids_of(tokenizer, text).tobytes()


def test_a_text_is_one_call_and_its_repetition_none(tokenizer, monkeypatch):
    encoder, asked = P.Encoder(VOCABULARY, RANKS, "<u2"), []
    ordinary = encoder._ordinary
    monkeypatch.setattr(encoder, "_ordinary", lambda text: asked.append(text) or ordinary(text))
    texts = ["to be packed", "to be packed", "", None, "to be packed", "other <|endoftext|>", "other <|endoftext|>", "and more"]
    assert [encoder.encode(t) for t in texts] == [ids_of(tokenizer, t).astype("<u2").tobytes() for t in texts]
    assert asked == ["to be packed", "and more"]


def test_hilbert_visits_every_cell_by_single_steps():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = P.hilbert(grid, 3)
    assert sorted(keys) == list(range(side**3))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def check(rows, texts, tokenizer, length):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for doc_id, parts in docs.items():
        ids = np.append(ids_of(tokenizer, texts[doc_id]), np.uint32(0)).astype("<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == zlib.crc32(r.ids)
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= length and (at == length or at & (at - 1) == 0)


def test_pieces_cover_every_document(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(P.pack(docs, 1024).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer, 1024)


def test_null_empty_long_and_copied_texts(spark, tokenizer):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "same text", 5: "same text", 6: "x" * 3000}
    docs = spark.createDataFrame([(k, v, k) for k, v in texts.items()], "doc_id long, text string, curve int")
    check(P.pack(docs, 64).collect(), texts, tokenizer, 64)
    assert P.pack(docs.limit(0), 64).count() == 0
    twice = P.pack(docs.union(docs), 64).collect()
    assert sum(r.length for r in twice) == 2 * sum(len(ids_of(tokenizer, t)) + 1 for t in texts.values())


def test_like_documents_are_neighbours():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, 400) + 2000 * (i % 4) for i in range(80)]
    keys = P.curve_keys(np.concatenate(docs), np.arange(80) * 400, 50_257)
    kinds = np.argsort(keys) % 4
    assert (kinds[1:] == kinds[:-1]).mean() > 0.7
