"""Token files (2) and packing (9) against plain encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm_fixtures import empty_docs, odd_docs
from tokenizers import Tokenizer

from postlens.llm import token_files
from postlens.llm.bpe import Encoder, default_path
from postlens.llm.packing import Packer, pack_documents


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path(), most_units=500)


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_units_equal_whole_texts(encoder):
    rng = random.Random(1)
    letters = list(" \n\t ab'sé.1  　\r日”—!-×÷$,ß ​")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "<|endoftext|> x", "a" * 5000]
    ids, offsets = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == plain(encoder, t), t


def test_added_token_names_equal_the_library(spark, encoder):
    fresh = Tokenizer.from_file(default_path())
    rng = random.Random(2)
    name = "<|endoftext|>"
    parts = [name, name, "<|endo", "ftext|>", "<|", "|>", " ", "  ", "\n", "a", "don", "'t", "é", "日", "!", " b", "12", "\t", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["<|endo", "ftext|>", None, name, "", name + name]
    ids, offsets = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == fresh.encode(t or "", add_special_tokens=False).ids, t
    docs = spark.createDataFrame([(1, f"a {name} b"), (2, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_files.token_digest(docs, end_id=2).collect()}
    assert got[1].ids_crc32 == zlib.crc32(np.array([64, 220, 50256, 275, 2], "<u4").tobytes()) and got[2].start == 5
    packed = pack_documents(docs.where("doc_id = 1"), end_id=1).collect()
    assert sum(r.length for r in packed) == packed[0].doc_tokens == 5


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 31, 32])
def test_pack_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    body = token_files.pack(ids, bits)
    assert len(body) <= 16 + (1001 * bits + 7) // 8
    assert (token_files.unpack(body) == ids).all()
    for a, b in ((0, 0), (0, 1), (7, 9), (500, 1001), (1000, 5000)):
        assert (token_files.unpack(body, a, b) == ids[a:b]).all()


def test_pack_rejects_what_does_not_fit():
    with pytest.raises(ValueError):
        token_files.pack(np.array([4]), 2)
    with pytest.raises(ValueError):
        token_files.unpack(b"x" * 16)
    assert token_files.width(50257) == 16 and token_files.width(2) == 1 and token_files.width(65537) == 17


def test_token_digest(spark, encoder):
    docs = odd_docs(spark)
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    got = sorted(token_files.token_digest(docs, block_ids=200).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    start = 0
    for (doc, text), r in zip(rows, got, strict=True):
        ids = np.array([*plain(encoder, text), 2], "<u4")
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_read_span(spark, encoder, tmp_path):
    docs = odd_docs(spark)
    out = str(tmp_path / "t")
    token_files.write_tokens(docs, out, block_ids=100)
    ids = plain(encoder, next(r.text for r in docs.collect() if r.doc_id == 9))
    assert token_files.read_span(spark, out, 9, 30, 60).tolist() == ids[30:60]
    with pytest.raises(KeyError):
        token_files.read_span(spark, out, 999, 0, 1)


def test_empty_tables(spark):
    assert token_files.token_digest(empty_docs(spark)).count() == 0
    assert pack_documents(empty_docs(spark)).count() == 0


def check_pieces(rows, expected, max_tokens, max_segments):
    """Every id once, sequences gapless and within their limits."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= max_tokens and len(own) <= max_segments
    total = sum(r["length"] for r in rows)
    assert total == sum(map(len, expected))
    return by_seq


def test_packing(spark, encoder):
    docs = odd_docs(spark)
    rows = [r.asDict() for r in pack_documents(docs, max_tokens=256, max_segments=5).collect()]
    texts = {r.doc_id: [*plain(encoder, r.text), 1] for r in docs.collect()}
    check_pieces(rows, [[*plain(encoder, r.text), 1] for r in docs.collect()], 256, 5)
    for r in rows:
        ids = np.array(texts[r["doc_id"]], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())


@pytest.mark.parametrize("limits", [(64, 3, 64), (64, 100, 20), (2048, 256, 2048)])
def test_packer_limits_and_padding(limits):
    rng = np.random.default_rng(4)
    packer = Packer(0, *limits, waiting=64, slack=0.01)
    items = [rng.integers(0, 50000, int(n)).astype(np.uint32) for n in rng.integers(1, 400, 500)]
    flags = [rng.random(len(x)) < 0.5 for x in items]
    for k, (x, f) in enumerate(zip(items, flags, strict=True)):
        packer.add(k, x, f)
    packer.finish()
    rows = packer.take().to_pylist()
    by_seq = check_pieces(rows, items, limits[0], limits[1])
    assert all(sum(r["loss_tokens"] for r in own) <= limits[2] for own in by_seq.values())
    if limits[0] == 2048:
        filled = [sum(r["length"] for r in own) for own in by_seq.values()]
        padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in filled)
        assert padding < 0.02 * sum(filled)
