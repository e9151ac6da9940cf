"""Exact and approximate searches against brute force."""

import numpy as np
import pytest

from aeolis.llm import curves, topk
from aeolis.llm.common import table

SF = "/root/testdata/sf0.001"


def usable(df, zero=True):
    out = {}
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[r["vec_id"]] = min(out.get(r["vec_id"], v), v)
    return out


def brute_top(vectors, k, every, score):
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            found = [(-score(v, w), i) for i, w in vectors.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def quantised(v, w):
    return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(v, w, strict=True))


@pytest.mark.parametrize("block", [1024, 16])
def test_top_k_is_exact(spark, edge_vectors, monkeypatch, block):
    monkeypatch.setattr(topk, "blocked", lambda r, q, f=topk.blocked: f(r, q, block))
    want = {q: r for q, r in brute_top(usable(edge_vectors), 5, 50, quantised).items() if r}
    assert got(topk.top_k(edge_vectors, 5, 50)) == want


def test_top_k_of_everything_and_nothing(spark, edge_vectors):
    want = {q: r for q, r in brute_top(usable(edge_vectors), 500, 50, quantised).items() if r}
    assert got(topk.top_k(edge_vectors, 500, 50)) == want
    assert topk.top_k(edge_vectors.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("block, size", [(1024, 2.0**21), (16, 2.0**21), (16, 2.0**45)])
def test_top_k_of_large_components(spark, monkeypatch, block, size):
    """Unscaled vectors among small ones; with sums that differ by less than a double can tell."""
    monkeypatch.setattr(topk, "blocked", lambda r, q, f=topk.blocked: f(r, q, block))
    rng = np.random.default_rng(2)
    small, large = rng.uniform(-1, 1, (40, 8)), np.floor(rng.uniform(-1, 1, (60, 8)) * size)
    near = np.tile(large[3], (12, 1)) + np.arange(12)[:, None] * np.eye(8)[0]
    vectors = [*small.tolist(), *large.tolist(), *near.tolist(), *near[:4].tolist(), [0.0] * 8]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert got(topk.top_k(df, 5, 4)) == brute_top(dict(enumerate(vectors)), 5, 4, quantised)


def test_hilbert_walks_through_all_cells():
    for axes, bits in ((2, 4), (3, 3), (4, 2), (1, 5)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        keys = curves.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_searched_whole(spark, edge_vectors):
    few = edge_vectors.where("vec_id < 60 or vec_id > 299 or vec_id is null")
    dot = lambda v, w: float((np.array(v) * np.array(w)).sum())
    want = {q: r for q, r in brute_top(usable(few, zero=False), 20, 20, dot).items() if r}
    found = got(curves.nearest(few))
    assert {q: [i for i, _ in r] for q, r in found.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(found[q], want[q], strict=True))
    assert curves.nearest(edge_vectors.where("vec_id < 0")).count() == 0


def test_recall(spark):
    vectors = table(spark, SF.replace("0.001", "0.1"), "embeddings")
    truth = usable(vectors)
    ids = np.array(list(truth))
    m = np.array([truth[i] for i in ids])
    hit = total = 0
    for q, rows in got(curves.nearest(vectors)).items():
        s = m @ np.array(truth[q])
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        hit, total = hit + len(best & {i for i, _ in rows}), total + 20
    assert hit / total >= 0.9


def test_recall_of_unequal_lengths(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(4000, 64))
    m *= (np.exp(rng.normal(size=4000)) / np.linalg.norm(m, axis=1))[:, None]
    found = got(curves.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")))
    hit = 0
    for q in range(0, 4000, 20):
        s = m @ m[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {i for i, _ in found[q]})
    assert hit / (200 * 20) >= 0.95  # plain projections find 0.8
