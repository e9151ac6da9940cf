"""Approximate nearest neighbours by shifted Hilbert curves of projected vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolis.llm.common import stage
from aeolis.llm.topk import finite, matrix

#: Curves; axes and bits of each; share of all rows on either side of a query that a window holds.
CURVES, AXES, BITS, WINDOW = 16, 6, 6, 0.05
#: Least rows on either side; rows of a block; bound of the sample that places the cells' borders.
LEAST, BLOCK, SAMPLE = 64, 4096, 8192



def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of every row of integer coordinates below 2^bits; at most 63 bits in all.

    From the highest bit down, the cube a point lies in is mirrored and its axes are exchanged so that neighbouring cubes meet;
    the bits left are a Gray code of the position.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for a in range(axes):
            set_ = (x[a] >> level & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[a]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[a] ^= swap
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for a in range(axes):
            out = out << 1 | x[a] >> level & 1
    return out


class Curve:
    """One curve over vectors of a dimension: a random projection, borders of cells by the sample's quantiles, and a shift."""

    def __init__(self, number: int, dim: int, sample: np.ndarray, axes: int = AXES, bits: int = BITS):
        rng = np.random.default_rng([number, dim])
        self.axes, self.bits = min(axes, max(1, dim)), bits
        self.plane = np.linalg.qr(rng.normal(size=(dim, self.axes)))[0] if dim else np.zeros((0, 1))
        shift = rng.random(self.axes)
        # The cells hold equal shares of the sample and fill half of the cube's side; the shift says which half.
        parts = 1 << (bits - 1)
        grid = (np.arange(1, parts + 1)[None, :] - shift[:, None]) / parts
        self.borders = np.stack([np.quantile(y, np.clip(g, 0, 1)) for y, g in zip((sample @ self.plane).T, grid, strict=True)])
        self.first = (shift * parts).astype(np.int64)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        y = vectors @ self.plane
        cells = np.stack([self.first[a] + np.searchsorted(self.borders[a], y[:, a], side="right") for a in range(self.axes)], axis=1)
        return hilbert(np.minimum(cells, (1 << self.bits) - 1), self.bits)


def lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Vectors with one axis more, all of length ``norm`` (the largest of any candidate), on which the candidates of larger inner
    product with a query are the nearer ones. Candidates get the length they lack on the new axis; queries are stretched, which
    changes no order among their candidates, and get 0."""
    square = (x * x).sum(axis=1)
    if query:
        return np.hstack([x * (norm / np.sqrt(square))[:, None], np.zeros((len(x), 1))])
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - square, 0.0))[:, None]])


def among_candidates(keyed: DataFrame) -> DataFrame:
    """``keyed`` (dim, curve, key, vec_id, side) with rank: how many candidates (side 0) of the dimension come before on the curve.

    As in :func:`aeolis.llm.common.ranked`, but queries (side 1) take no place of their own.
    """
    order = ["dim", "curve", "key", "vec_id", "side"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)

    def count(batches):
        at = 0
        for b in batches:
            there = (b["side"].to_numpy() == 0).astype(np.int64)
            yield pa.record_batch([*b.columns, pa.array(at + np.cumsum(there) - there)], [*b.schema.names, "at"])
            at += int(there.sum())

    counted = dealt.mapInArrow(count, "dim int, curve int, key long, vec_id long, side int, at long").drop("key")
    held = stage(counted.withColumn("part", F.spark_partition_id()), "curve-order")
    parts = held.groupBy("dim", "curve", "part").agg(F.sum(1 - F.col("side")).alias("size"), F.min("at").alias("first"))
    before = F.sum("size").over(Window.partitionBy("dim", "curve").orderBy("part")) - F.col("size")
    parts = stage(parts.select("dim", "curve", "part", (before - F.col("first")).alias("shift")), "curve-order-parts")
    return held.join(parts, ["dim", "curve", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _best(k: int, reach: dict[int, int]):
    """Score the queries' windows inside one block and keep each query's best, with exact sums in a fixed order."""

    def score(key, t):
        dim, side, ids, rank = key[1].as_py(), t["side"].to_numpy(), t["vec_id"].to_numpy(), t["rank"].to_numpy()
        x = matrix(t["embedding"], dim).astype(np.float64)
        c, width = np.flatnonzero(side == 0), reach[dim]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        c = c[np.argsort(rank[c], kind="stable")]
        for part in np.array_split(np.flatnonzero(side == 1), max(1, -(-int((side == 1).sum()) // 256))):
            if not len(part) or not len(c):
                continue
            s = x[part] @ x[c].T
            far = np.abs(rank[part][:, None] - rank[c][None, :]) > width
            s[far | (ids[part][:, None] == ids[c][None, :])] = -np.inf
            # Anything that rounding could lift among the best is summed again.
            least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            norms = np.linalg.norm(x[part], axis=1) * np.linalg.norm(x[c], axis=1).max()
            i, j = np.nonzero((s >= (least - 1e-12 * norms)[:, None]) & (s > -np.inf))
            exact = (x[part[i]] * x[c[j]]).sum(axis=1)
            order = np.lexsort((ids[c[j]], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            out.append((ids[part[i]][place < k], ids[c[j]][place < k], exact[place < k]))
        q, v, e = (np.concatenate(o) for o in zip(*out, strict=True))
        return pa.table({"query_id": q.astype(np.int64), "vec_id": v.astype(np.int64), "score": e})

    return score


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """The ``k`` rows of largest inner product found for every query; queries are the rows whose id is divisible by ``every``.

    Vectors get one axis more, on which all have the length of the longest, so that the largest inner products are the least
    distances whatever the vectors' lengths; queries have places of their own. Every row is placed on each of several Hilbert
    curves, each over a projection, a quantile grid and a shift of its own. A curve's order is made by a range partition and a
    sort. A query meets the rows up to ``window`` times all rows before and
    after it (at least 64): blocks of the order score the windows that touch them and keep each query's best, which merge over
    all curves. Windows are a share of the rows, so that recall doesn't fall as the table grows. Scores are inner products in
    double precision, ties go to the smaller id.

    Vectors that are NULL, zero, or hold NULL or non-finite components take no part; an id names one vector, of repeated ids the
    smallest counts; vectors of different lengths are no candidates for each other. No usable rows: an empty result.
    """
    rows = finite(vectors).where(F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    rows = stage(rows, "curve-vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    found = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm")).collect()  # one row for a number of axes
    sizes, norms = {r["dim"]: r["n"] for r in found}, {r["dim"]: r["norm"] for r in found}
    reach = {d: max(LEAST, int(np.ceil(window * n))) for d, n in sizes.items()}
    place = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_003)) / 1_000_003.0
    share = F.element_at(F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, SAMPLE / n)))), F.col("dim")) if sizes else F.lit(1.0)
    drawn = rows.where(place <= share).select("dim", "embedding").toArrow()  # bounded by the sample
    samples = {d: matrix(drawn["embedding"].filter(pa.array(drawn["dim"].to_numpy() == d)), d).astype(np.float64) for d in sizes}
    samples = {d: lifted(x, norms[d], False) if len(x) else np.zeros((1, d + 1)) for d, x in samples.items()}
    index = {d: [Curve(i, d + 1, samples[d]) for i in range(curves)] for d in sizes}

    def place_rows(batches):
        for b in batches:
            dims = b["dim"].to_numpy()
            for d in np.unique(dims):
                of = pa.table(b).filter(pa.array(dims == d))
                x = matrix(of["embedding"], int(d)).astype(np.float64)
                ids = of["vec_id"].to_numpy()
                for side, at in ((0, np.arange(len(ids))), (1, np.flatnonzero(ids % every == 0))):
                    y, n = lifted(x[at], norms[int(d)], side == 1), len(at)
                    keys = np.concatenate([c.keys(y) for c in index[int(d)]])
                    cols = [np.full(n * curves, d, np.int32), np.repeat(np.arange(curves, dtype=np.int32), n), keys, np.tile(ids[at], curves), np.full(n * curves, side, np.int32)]
                    yield pa.record_batch([pa.array(c) for c in cols], ["dim", "curve", "key", "vec_id", "side"])

    order = among_candidates(rows.mapInArrow(place_rows, "dim int, curve int, key long, vec_id long, side int"))
    placed = order.join(rows.select(F.col("vec_id").alias("of"), "embedding"), F.col("vec_id") == F.col("of")).drop("of")
    width = F.element_at(F.create_map(*(F.lit(x) for d, n in reach.items() for x in (d, n))), F.col("dim")) if sizes else F.lit(LEAST)
    count = F.element_at(F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, n))), F.col("dim")) if sizes else F.lit(1)
    block = lambda c: F.floor(c / BLOCK).cast("long")
    there = placed.where("side = 0").withColumn("block", block(F.col("rank")))
    met = F.sequence(block(F.greatest(F.col("rank") - width, F.lit(0))), block(F.least(F.col("rank") + width, count - 1)))
    here = placed.where("side = 1").withColumn("block", F.explode(met))
    scored = there.unionByName(here).groupBy("block", "dim", "curve").applyInArrow(_best(k, reach), "query_id long, vec_id long, score double")
    once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
