"""SentencePiece encoding and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from causeway.llm import packing, piece_bpe

PATH = public_tokenizers.path(piece_bpe.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ALPHABET = st.sampled_from([*"ab =-_\n\tthe.0xé▁我😀", " ", "  ", "the", "ing", "\r\n", "//", "=="])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join))
def test_encode_and_decode_equal_the_library(text):
    ids = piece_bpe.model(PATH).encode_batch([text], {})[0]
    wanted = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == wanted
    assert piece_bpe.model(PATH).decode(ids) == LIBRARY.decode(wanted)


def test_long_runs():
    for text in ("a" * 5000, "ha" * 3000, " " * 3000, " " * 100 + "x", "xyz" * 2000):
        ids = piece_bpe.model(PATH).encode_batch([text], {})[0]
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_digests_of_every_row(spark, docs, empty):
    rows = piece_bpe.digests(docs).collect()
    assert len(rows) == docs.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {2}
    assert piece_bpe.digests(empty).count() == 0


def test_byte_ids_equal_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    own = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    rnd = random.Random(5)
    assert own.added and np.frombuffer(own.encode(own.added[0] + " hi"), "<u4").tolist() == whole.encode(own.added[0] + " hi", add_special_tokens=False).ids
    for _ in range(600):
        text = "".join(rnd.choice([*"ab é'st \n\t01²½ـ我.", *own.added, "<|endof", "text|>", "'ll"]) for _ in range(rnd.randint(0, 50)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_very_long_runs_are_encoded():
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    own = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    for text in (" " * 1_000_000 + "a", "\n" * 1_000_000, "a" * 1_000_000, "7" * 1_000_000, " " * packing.LONG):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_level_choice_is_the_best():
    rnd = random.Random(3)
    packer = packing.Packer(32)
    for _ in range(300):
        n = rnd.randint(1, 31)
        before = packer.count.copy()

        def cost(level, n=n, before=before):
            after = before.copy()
            if level:
                after[level] -= 1
            if level + n < 32:
                after[level + n] += 1
            return int((after * after).sum())

        allowed = [0] + [h for h in range(1, 32) if before[h] and h + n <= 32]
        assert cost(packer.level_for(n)) == min(map(cost, allowed))
        packer.put("d", 0, b"\0\0\0\0" * n)


def test_closing_the_level_array_fills_windows_exactly():
    """All but the last window's powers of two are full, every token stays, and most placed windows stay as they were placed."""
    rnd = random.Random(9)
    for count in (0, 1, 2, 3, 40, 500):
        packer, done, put = packing.Packer(64), [], {}
        for d in range(count):
            ids = np.arange(rnd.randint(1, 63), dtype="<u4") + 100 * d
            put[d] = ids.tolist()
            done += packer.put(d, 0, ids.tobytes())
        open_ = [[p[0] for p in w] for level in packer.at for w in level]
        closed = packer.close()
        sizes = [sum(len(ids) // 4 for *_, ids in w) for w in done + closed]
        assert all(s == 64 or s & (s - 1) == 0 for s in sizes) and len([s for s in sizes if s < 64]) <= 6
        found = {}
        for d, start, ids in sorted((p for w in done + closed for p in w), key=lambda p: p[:2]):
            assert start == len(found.setdefault(d, []))
            found[d] += np.frombuffer(ids, "<u4").tolist()
        assert found == put and packer.count.sum() == 0 and packer.close() == []
        if count == 500:
            kept = sum(any(w == [p[0] for p in c][: len(w)] for c in closed) for w in open_)
            assert kept > len(open_) / 2


def test_pieces_hold_every_id_once(spark, docs, empty):
    own = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    pieces = packing.pack(docs, window=64).collect()
    for r in docs.where("doc_id is not null and doc_id <> 5").collect():
        mine = sorted((p for p in pieces if p["id"] == r["doc_id"]), key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in mine) == own.encode(r["text"] or "") + np.array([1], "<u4").tobytes()
        assert [p["start"] for p in mine] == [sum(q["length"] for q in mine[:i]) for i in range(len(mine))]
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p)
    for own_pieces in windows.values():
        own_pieces.sort(key=lambda p: p["offset"])
        total = 0
        for p in own_pieces:
            assert p["offset"] == total
            total += p["length"]
        assert total == own_pieces[0]["sequence_length"] and (total == 64 or total & (total - 1) == 0)
    assert packing.pack(empty).count() == 0
    row = packing.placements(docs).where("doc_id = 0").first()
    assert row["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())
