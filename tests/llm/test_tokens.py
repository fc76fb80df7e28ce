import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.helpers import awkward, empty
from tokenizers import Tokenizer

from millrace.llm import bpe, packing, token_store
from millrace.llm.tokens import PieceEncoder, in_runs

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​'sdlmtreve123é漢字ñ<|>.!?A\0\U0001F600́²½Σİß") + ["<|endoftext|>", "'ll", " the"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, weights=[12] + [1] * (len(ALPHABET) - 1), k=rng.randint(0, 14))) for _ in range(n)]


def test_pieces_give_the_librarys_ids():
    encoder, library = PieceEncoder(BYTES, memo_bytes=100_000), Tokenizer.from_file(BYTES)
    for seed in range(40):
        some = [*texts(20, seed), None]
        ids, begin = encoder.batch(some)
        for i, t in enumerate(some):
            assert ids[begin[i] : begin[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_backtracking_gives_the_librarys_ids_and_decoding():
    encoder, library = bpe.WordEncoder(WORDS, memo_bytes=100_000), Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    for seed in range(40):
        words = ["".join(rng.choices("abcdeinorstlhu", k=rng.randint(1, 25))) for _ in range(10)]
        some = [*texts(20, seed), *words, "a" * 50, "<|startoftext|>x <|endoftext|>", None]
        ids, begin = encoder.batch(some)
        decoded = encoder.vocabulary.decode(ids, begin).to_pylist()
        for i, t in enumerate(some):
            want = library.encode(t or "", add_special_tokens=False).ids
            assert ids[begin[i] : begin[i + 1]].tolist() == want
            assert decoded[i] == library.decode(want, skip_special_tokens=False)


def test_pair_table_agrees_with_the_merges():
    v = bpe.Vocabulary(WORDS)
    assert v.backtrack("the" + bpe.END) == [v.id_of["the" + bpe.END]]
    assert all(v.rank[i] >= 0 for i in v.backtrack("hello" + bpe.END))


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_round_trip(planes):
    for n in (0, 1, 7, 8, 1001):
        block = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
        assert (token_store.from_planes(token_store.to_planes(block, planes), n) == block).all()


@pytest.mark.parametrize("planes", [4, 32])
def test_container_reads_any_slice(planes):
    ids = np.random.default_rng(1).integers(0, 50_000, 5_000).astype("<u4")
    raw = token_store.pack(3, 4, [7, None], np.array([2_000, 3_000]), ids, block_ids=512, planes=planes)
    box = token_store.Container(raw + b"\n")
    assert (box.part, box.number, box.doc_ids, box.n_ids) == (3, 4, [7, None], 5_000)
    for start, n in ((0, 5_000), (511, 2), (512, 512), (4_999, 1), (100, 0), (1_000, 3_333)):
        assert (box.read_ids(start, n) == ids[start : start + n]).all()
    with pytest.raises(ValueError):
        token_store.Container(b"x" * 100)


def test_store_round_trip(spark):
    library = Tokenizer.from_file(BYTES)
    docs = awkward(spark, ["start", "n_tokens", "part"])
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for how in ({}, {"container_ids": 1, "planes": 32}):
        got = token_store.round_trip(docs, BYTES, **how).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.round_trip(empty(spark), BYTES).count() == 0


def test_digests_take_awkward_rows(spark):
    import hashlib

    library = Tokenizer.from_file(WORDS)
    docs = awkward(spark, ["n_tokens", "ids"])
    got = sorted(map(tuple, bpe.digests(docs, WORDS).collect()), key=repr)
    want = []
    for key, text in docs.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(empty(spark), WORDS).count() == 0
    full = bpe.encode(docs, WORDS).where("doc_id = 8").first()
    assert full.ids == library.encode("x", add_special_tokens=False).ids


def test_packing_places_every_piece(spark):
    library = Tokenizer.from_file(BYTES)
    docs = awkward(spark, ["length", "offset", "sequence_id"])
    got = packing.pack(docs, BYTES).collect()
    by_doc = {}
    for key, text in docs.select("doc_id", "text").collect():
        by_doc.setdefault(key, []).append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    room = {}
    for r in got:
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in by_doc[r.doc_id])
        assert 0 < r.length <= 1024 and (r.piece == 0) == (r.start == 0)
        assert r.length == 1024 or r.piece == 0
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert total == sum(len(i) for v in by_doc.values() for i in v)
    assert len(room) <= -(-total // 1024) + 1
    assert packing.pack(empty(spark), BYTES).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_constraint(rule):
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 500, 80), rng.integers(1, 60, 80))}
    limits = {"max_docs": 5, "max_cost": 400_000}
    bins, used = {}, {}
    for length, rank, many, first, offset in packing.plan(counts, 1024, rule=rule, **limits):
        for i in range(many):
            bins.setdefault(first + i, []).append((offset, length))
            used.setdefault(length, []).append(rank + i)
    assert {k: len(v) for k, v in used.items()} == counts
    assert all(sorted(v) == list(range(len(v))) for v in used.values())
    for parts in bins.values():
        assert sum(n for _, n in parts) <= 1024 and len(parts) <= 5 and sum(n * n for _, n in parts) <= 400_000
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({700: 1}, 1024, max_cost=400_000)


def test_runs_cover_all():
    texts = ["abc", None, "", "x" * 10, "yy"]
    assert [t for s in in_runs(texts, 5) for t in texts[s]] == texts
