"""Ids, shards, index and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from aeolis.llm import packing, tokens
from aeolis.llm.queries import tokenizer

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def direct(name):
    t = Tokenizer.from_file(tokenizer(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", FILES)
def test_pieces_have_the_ids_of_the_text(name, edge_rows):
    rng = random.Random(1)
    alphabet = ["a", "B", " ", "\n", ".", ",", "'s", "_", "1", "é", "́", " ", "\t", "\x00", "你", "»", "don't", "<|endoftext|>", "ß", "İ", "Σ"]
    texts = ["".join(rng.choices(alphabet, weights=[6, 6, 9, 2] + [1] * 17, k=rng.randint(0, 25))) for _ in range(3000)]
    texts += [r[1] for r in edge_rows if r[1] is not None]
    encode, tool = direct(name), tokens.Encoder(tokenizer(name))
    for at in range(0, len(texts), 500):
        for t, b in zip(texts[at : at + 500], tool.encode(texts[at : at + 500]), strict=True):
            assert np.frombuffer(b, "<u4").tolist() == encode(t), repr(t[:80])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    tool, encode = tokens.Encoder(tokenizer(FILES[1])), direct(FILES[1])
    for text in ("one two three. four", "two five, six seven eight nine", "one two ten"):
        assert np.frombuffer(tool.encode([text])[0], "<u4").tolist() == encode(text)


@pytest.mark.parametrize("name", FILES)
def test_joined_pieces_keep_their_ids(name, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 400)
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "\u0301", "\u030c", "J", "\x01", " ", "\n", ".", "%", "'ll", "7", "Σ", "İ", "\u200d", "Ā", "</w>", "你"]
    texts = ["".join(rng.choices(alphabet, weights=[6, 6, 3, 1, 1, 2, 0.2, 12, 2] + [1] * 10, k=rng.randint(0, 40))) for _ in range(2000)]
    encode, tool = direct(name), tokens.Encoder(tokenizer(name))
    for at in range(0, len(texts), 100):
        for t, b in zip(texts[at : at + 100], tool.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(b, "<u4").tolist() == encode(t), repr(t)


def test_pieces_met_often_are_encoded_once(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 60)
    tool, encode, seen = tokens.Encoder(tokenizer(FILES[0])), direct(FILES[0]), []
    joined = tool._joined
    monkeypatch.setattr(tool, "_joined", lambda pieces: seen.extend(pieces) or joined(pieces))
    often = " ".join(f"often{chr(97 + i)}" for i in range(10))
    for i in range(20):
        text = f"{often} " + " ".join(f"rare{chr(97 + i)}{chr(97 + j)}" for j in range(20)) + f" {often}"
        assert np.frombuffer(tool.encode([text])[0], "<u4").tolist() == encode(text)
    assert all(seen.count(f" often{chr(97 + i)}") == 1 for i in range(1, 10))
    assert len(tool.known) <= 60


@pytest.mark.parametrize("shard_ids, index_keys", [(tokens.SHARD_IDS, tokens.INDEX_KEYS), (100, 3)])
def test_round_trip(spark, edge, empty, edge_rows, shard_ids, index_keys):
    encode = direct(FILES[0])
    found = [tuple(r) for r in tokens.binary_round_trip(edge, tokenizer(FILES[0]), 2, shard_ids, index_keys).collect()]
    found.sort(key=lambda r: r[1])
    order = [r[0] for r in found]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()
    want = sorted(((i if i is not None else -1), len(encode(t)) + 1, crc([*encode(t), 2])) for i, t, *_ in edge_rows)
    assert sorted(((r[0] if r[0] is not None else -1), r[2], r[3]) for r in found) == want
    assert tokens.binary_round_trip(empty, tokenizer(FILES[0])).count() == 0


def test_index_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    index = tokens.build_index(keys, np.arange(len(keys))[:, None])
    at = tokens.search_index(index, keys)
    assert sorted(at) == list(range(len(keys)))
    assert (index["values"][at, 0] == np.arange(len(keys))).all()
    strangers = np.setdiff1d(rng.integers(0, 1 << 63, 20_000).astype(np.uint64), keys)
    assert (tokens.search_index(index, strangers) >= 0).mean() < 0.001
    none = tokens.build_index(np.empty(0, np.uint64), np.empty((0, 1), np.int64))
    assert (tokens.search_index(none, strangers[:5]) == -1).all()


def test_keyed_access_returns_the_ids(spark, edge, edge_rows):
    folder, entries = tokens.write_ids(edge, tokenizer(FILES[0]), 2, shard_ids=100)
    files = tokens.write_index(folder, entries, 3)
    keys = spark.createDataFrame([(8,), (12,), (777,)], "doc_id long")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.read_ids(folder, files, keys, with_ids=True).collect())
    encode = direct(FILES[0])
    assert got == sorted((i, [*encode(t), 2]) for i, t, *_ in edge_rows if i in (8, 12))


def test_fill_finds_the_least_padding():
    rng = random.Random(2)
    for _ in range(300):
        window = 64
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 40), 5)}
        room = rng.randint(1, 63)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        chosen = packing.fill(counts, room, window)
        assert all(0 < k <= counts[n] for n, k in chosen)
        used = window - room
        assert packing.padding(used + sum(n * k for n, k in chosen), window) == min(packing.padding(used + s, window) for s in sums)


@pytest.mark.parametrize("window", [2048, 16])
def test_every_id_is_packed_once(spark, edge, empty, edge_rows, window):
    ids = {t: [*direct(FILES[1])(t), 1] for _, t, *_ in edge_rows}
    rows = packing.pack(edge, tokenizer(FILES[1]), 1, window, with_ids=True).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0) and r["ids_crc32"] == crc(r["ids"]) and len(r["ids"]) == r["length"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= window and sorted(by) == list(range(len(by)))
    want = sorted((i if i is not None else -1, at, ids[t][at : at + window], len(ids[t])) for i, t, *_ in edge_rows for at in range(0, len(ids[t]), window))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["ids"], r["doc_tokens"]) for r in rows) == want
    assert packing.pack(empty, tokenizer(FILES[1])).count() == 0
