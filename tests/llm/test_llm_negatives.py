"""Threshold joins and hard negatives against brute force."""

import random

import numpy as np
import pytest

from aeolis.llm import negatives


def exact(v, w):
    return sum(int(a) * int(b) for a, b in zip(v, w, strict=True))


def brute(rows, positives, n, every, low=30, high=90, scale=256):
    """Rows of (vec_id, embedding, label); every row counts."""
    held = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, vec_id, [int(np.floor(scale * x)) for x in v], label))
    rank = lambda s, vec_id: (-s, vec_id is None, vec_id or 0)
    out = []
    for i, vec_id, v, label in held:
        if vec_id is None or vec_id % every:
            continue
        met = [(exact(v, w), j, l) for r, j, w, l in held if r != i and len(w) == len(v)]
        for ps, pid in sorted(((s, j) for s, j, l in met if l == label), key=lambda t: rank(*t))[:positives]:
            inside = sorted(((s, j) for s, j, l in met if l != label and low * ps <= 100 * s <= high * ps), key=lambda t: rank(*t))
            out += [(vec_id, pid, at + 1, nid, ps, ns) for at, (ns, nid) in enumerate(inside[:n])]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("least", [-np.inf, -50.0, 0.0, 40.0, 200.0, 1e9])
def test_threshold_join_finds_exactly_the_pairs(least):
    rng = np.random.default_rng(1)
    q, x = np.floor(rng.normal(size=(37, 21)) * 10), np.floor(rng.normal(size=(150, 21)) * np.exp(rng.normal(size=(150, 1))) * 10)
    x[3], q[5] = 0, 0
    limits = np.where(np.arange(37) % 3 == 0, -np.inf, least) if least < 1e9 else np.full(37, least)
    i, j, s = negatives.over(q, x, limits)
    all_ = (q @ x.T).astype(np.int64)
    want = {(a, b, int(all_[a, b])) for a, b in zip(*np.nonzero(all_ >= limits[:, None]), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == want and len(i) == len(want)


def test_index_leaves_short_vectors_and_first_axes_out():
    x = np.array([[1.0, 0, 0, 3], [1, 1, 1, 10], [0, 0, 0, 2]])
    index = negatives.Index(x, 3.5)
    assert index.start.tolist() == [4, 3, 4] and negatives.Index(x, 0).start.tolist() == [0, 0, 0]


@pytest.fixture(scope="module")
def labelled(edge_vectors):
    rng = random.Random(8)
    rows = [(r["vec_id"], r["embedding"], rng.choice([0, 0, 0, 1, 2, 3])) for r in edge_vectors.collect()]
    rows += [(500 + i, [rng.gauss(0, 1) + (i % 3) for _ in range(8)], i % 3) for i in range(90)]
    rows += [(600, rows[3][1], None), (700, [1.0] * 8, 77), (None, [0.5] * 8, 0), (None, [0.5] * 8, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, dim int"


@pytest.mark.parametrize("block, anchors, every", [(8192, 1024, 20), (16, 4, 20), (50, 8, 3)])
def test_hard_negatives_are_exact(spark, labelled, block, anchors, every):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in labelled], SCHEMA)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in labelled]
    got = negatives.hard_negatives(df, 5, 4, every, block=block, anchors=anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert ordered(got.collect()) == ordered(brute(rows, 5, 4, every))


def test_hard_negatives_of_large_components(spark):
    """Scores beyond 2^53, some of which differ by less than a double can tell."""
    rng = np.random.default_rng(4)
    base = np.floor(np.abs(rng.normal(size=(40, 6))) * 2.0**19)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(np.vstack([base, base[:20] + np.eye(6)[np.arange(20) % 6]]))]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 3, 5, 10)
    want = brute(rows, 3, 5, 10)
    assert max(r[4] for r in want) > 2**53 and ordered(got.collect()) == ordered(want)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, 2, 3)], SCHEMA)
    assert negatives.hard_negatives(negatives.relabelled(alone)).count() == 0
