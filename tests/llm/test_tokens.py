import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import common, encode, packing, token_count, token_files
from graphloom.llm.encode import Encoder

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name):
    tokenizer = common.load_tokenizer(common.tokenizer_path(name))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(docs):
    ids = library(BYTES)
    rows = token_count.token_counts(docs, common.tokenizer_path(BYTES), limit=50).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["n_tokens"] == len(ids(texts[r["doc_id"]])), texts[r["doc_id"]]
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
        assert r["over_limit"] == (r["n_tokens"] > 50)


def test_counts_of_an_empty_table(empty):
    assert token_count.token_counts(empty, common.tokenizer_path(BYTES)).count() == 0


def test_whole_tokens_are_proved():
    path = common.tokenizer_path(BYTES)
    assert token_count.applies(path)
    assert not token_count.applies(common.tokenizer_path(WORDS))
    whole = token_count.prove(path)
    ids = library(BYTES)
    assert len(whole) > 40_000
    assert all(len(ids(s)) == 1 for s in whole[::97])


def test_other_tokenizers_are_counted_too(texts):
    path = common.tokenizer_path(WORDS)
    counter = token_count.Counter(path, None)
    ids = library(WORDS)
    assert [counter.count(t or "") for t in texts[:30]] == [len(ids(t)) for t in texts[:30]]


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_encoder_is_the_library(texts, name):
    encoder, ids = Encoder(common.tokenizer_path(name)), library(name)
    for t in texts:
        assert np.frombuffer(encoder.encode((t or "").encode()), encoder.dtype).tolist() == ids(t)


def test_files_round_trip(spark, docs, tmp_path):
    ids = library(WORDS)
    folder = f"file://{tmp_path}/out"
    parts = token_files.write_token_files(docs, folder, common.tokenizer_path(WORDS), end_id=1)
    rows = sorted(token_files.read_token_files(spark, folder, parts).collect(), key=lambda r: r["start"])
    inputs = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    assert [r["doc_id"] for r in rows] == [d for d, _ in inputs]
    for r, (_, text) in zip(rows, inputs, strict=True):
        expected = np.array([*ids(text), 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(expected), zlib.crc32(expected.tobytes()))
        at += len(expected)
    assert sum(p["n_tokens"] for p in parts) == at
    flat = np.concatenate([token_files.read_part(str(tmp_path / "out"), p["part"], p["dtype"])[0] for p in parts])
    assert len(flat) == at and flat.dtype == np.uint16


def test_files_of_an_empty_table(spark, empty, tmp_path):
    folder = f"file://{tmp_path}/none"
    parts = token_files.write_token_files(empty, folder, common.tokenizer_path(WORDS), end_id=1)
    assert token_files.read_token_files(spark, folder, parts).count() == 0


def test_packing_places_every_token_once(docs):
    ids = library(WORDS)
    capacity = 128
    rows = packing.pack_documents(docs, common.tokenizer_path(WORDS), capacity=capacity).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held, seen = defaultdict(list), defaultdict(int)
    for r in rows:
        whole = np.array([*ids(texts[r["doc_id"]]), 0], "<u4")
        part = whole[r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * capacity and len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert r["length"] == min(capacity, len(whole) - r["start"])
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(ids(r["text"])) + 1 for r in docs.collect())
    assert sum(seen.values()) == total
    assert len(held) <= 1.05 * total / capacity + 2


def test_packing_an_empty_table(empty):
    assert packing.pack_documents(empty, common.tokenizer_path(WORDS)).count() == 0


def test_bins_close_in_a_stream(spark):
    """As many lengths as need far more bins than may be open: most close, and little is lost by it."""
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 2049, 6000)
    packer, most = packing.BestFit(2048, packing.OPEN_BINS // 8), 0
    for n in lengths.tolist():
        packer.put(n)
        most = max(most, packer.n_open)
    assert most == packing.OPEN_BINS // 8 and packer.opened > 20 * most
    assert packer.opened <= 1.06 * lengths.sum() / 2048
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0, int(s)) for i, (n, s) in enumerate(zip(lengths, rng.permutation(6000), strict=True))], "id long, piece int, start long, length long, ids_crc32 long, salt long")
    rows = packing.pack(pieces, 2048, open_bins=64, group_pieces=2000).collect()
    assert {r["id"] for r in rows} == set(range(6000)) and len({r["sequence_id"] for r in rows}) <= 1.06 * lengths.sum() / 2048


def test_best_fit_with_few_bins():
    packer = packing.BestFit(10, open_bins=2)
    assert packer.put(6) == (0, 0)
    assert packer.put(7) == (1, 0)
    assert packer.put(3) == (1, 7)  # fills the fuller one
    assert packer.put(5) == (2, 0)
    assert packer.put(8) == (3, 0)  # a third bin with room: the fullest, this one, closes
    assert packer.put(4) == (0, 6)
    assert packer.put(2) == (2, 5)
    assert packer.n_open == 1


def test_encoder_sorts_runs_apart_at_sixteen_bytes_and_when_hashes_meet(monkeypatch):
    rng = random.Random(11)
    texts = [b"", b" ", b"a\0", b"a", b"a\0\0 a a\0", b"x" * 16, b"x" * 17, b"x" * 15 + b"\0", b"<|endoftext|> A", b"<|ENDOFTEXT|>"]
    texts += ["".join(rng.choices("abAB \t\n\0é'.中", k=rng.choice([3, 9, 40, 200]))).encode() for _ in range(600)]
    for factors in (encode.MIX, np.zeros(3, np.uint64)):
        monkeypatch.setattr(encode, "MIX", factors)
        monkeypatch.setattr(encode, "RUNS_TOGETHER", 500)
        encoder = encode.Encoder(common.tokenizer_path("word_bpe_49k.json"))
        assert encoder.encode_all(texts) == [encoder.ask(t.decode()) for t in texts]
        assert encoder.encode_all([]) == []
