"""Byte-level BPE against the library it must equal."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from causeway.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.VOCABULARY)
OWN, LIBRARY = byte_bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
PARTS = st.sampled_from([*"ab é'sRt \n\t01²½ـ我.\x85\x1c​́😀ǅⅣ٣", " ", "  ", "\r\n", "the", "'ll", "'re", "'S", "<|endoftext|>", "<|endof", "text|>"])


def ids_of(texts):
    return [np.frombuffer(b, "<i4") for b in OWN.encode_batch(texts, {})]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=40).map("".join), max_size=4))
def test_equals_the_library(texts):
    for text, ids in zip(texts, ids_of(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert OWN.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_characters(text):
    assert ids_of([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_any_ids_decode_as_the_library_does():
    rnd = random.Random(3)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 20))]
        assert OWN.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "a" * 300_000, "1" * 300_000, "\n" * 300_000, "ha" * 100_000, "".join(random.Random(1).choices("abcXYZ012", k=200_000))])
def test_very_long_runs(text):
    assert ids_of([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_no_token_crosses_a_certain_cut():
    for token in LIBRARY.get_vocab():
        if token not in OWN.added:
            raw = bytes(byte_bpe._byte_of_char()[c] for c in token)
            assert not any(OWN.never[a << 8 | b] for a, b in zip(raw, raw[1:]))
    assert OWN.never.mean() > 0.9


def test_fragments_join_to_the_text_and_the_store_stays_small(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STORE", 10)
    monkeypatch.setattr(byte_bpe, "PART_CHARS", 25)
    texts, store = ["The quick brown fox isn't here. " * 3, "ein wäßriger Text\n\n mit Zeilen", "x"], {}
    assert [b"".join(p).decode() for p in OWN.fragments(texts)] == texts
    found = OWN.encode_batch(texts, store)
    assert [np.frombuffer(b, "<i4").tolist() for b in found] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(store) <= 30


def test_digests_of_every_row(spark, docs, empty):
    import hashlib

    rows = byte_bpe.digests(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert byte_bpe.digests(empty).count() == 0
