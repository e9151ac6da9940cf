"""Exact top-k inner products by distributed refinement of score histograms."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolis.llm.common import stage

#: Rows of one block of candidates and of one block of queries: a task scores one pair of blocks at a time.
BLOCK = 1024
#: Bins of one histogram.
BINS = 1024
#: Queries whose scores could pass this are scored with integers of any length, without histograms.
WIDE = float(1 << 61)


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the usable rows: id known, vector known, all components known and finite.

    An id names one vector: of repeated ids the smallest vector counts. Other columns are left out.
    """
    usable = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def blocked(rows: DataFrame, queries: DataFrame, block: int = BLOCK):
    """Both tables dealt to (query block, candidate block) groups of bounded size, one group for each pair of blocks."""
    n, m = -(-max(1, rows.count()) // block), -(-max(1, queries.count()) // block)
    there = rows.withColumn("db", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    there = there.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    here = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int"))
    here = here.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return here, there


def scores(left: pa.Table, right: pa.Table):
    """For each dimension present: positions of the queries, ids of the candidates, exact scores, and which pairs are no candidates."""
    ld, rd = left["dim"].to_numpy(), right["dim"].to_numpy()
    lid, rid = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    for dim in np.intersect1d(ld, rd):
        at, to = np.flatnonzero(ld == dim), np.flatnonzero(rd == dim)
        q, x = matrix(left["v"].take(pa.array(at)), dim), matrix(right["v"].take(pa.array(to)), dim)
        bound = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(x).max(initial=0))
        if bound < 2.0**53:  # sums of integers below 2^53 are exact in doubles
            s = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        else:
            s = q.astype(np.int64) @ x.astype(np.int64).T
        yield at, rid[to], s, lid[at][:, None] == rid[to][None, :]


def _histogram(k: int):
    def counts(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 3]
        lid, low, width, span, above = (left[c].to_numpy() for c in ("vec_id", "low", "width", "span", "above"))
        for at, _, s, own in scores(left, right):
            s = s - low[at][:, None]
            ok = (s >= 0) & (s < span[at][:, None]) & ~own  # what lies higher is already in ``above``
            b = s // width[at][:, None]
            cell = (np.arange(len(at))[:, None] * BINS + b)[ok]
            h = np.bincount(cell, minlength=len(at) * BINS).reshape(len(at), BINS)
            higher = h[:, ::-1].cumsum(axis=1)[:, ::-1] - h
            # A bin below this block's own k-th value can't hold the global one.
            i, j = np.nonzero((h > 0) & (higher + above[at][:, None] < k))
            out.append((lid[at][i], j, h[i, j]))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_id", "bin", "n"), cols, strict=True)))

    return counts


def _select(k: int):
    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 3]
        lid, kth = left["vec_id"].to_numpy(), left["low"].to_numpy()
        for at, ids, s, own in scores(left, right):
            order = np.argsort(ids, kind="stable")
            s, own, ids = s[:, order], own[:, order], ids[order]
            tie = (s == kth[at][:, None]) & ~own
            keep = (s > kth[at][:, None]) & ~own | tie & (tie.cumsum(axis=1) <= k)  # ties: the smallest ids of the block
            i, j = np.nonzero(keep)
            out.append((lid[at][i], ids[j], s[i, j]))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return found


def _wide(k: int):
    """Each query's best of a block by exact integers: doubles with a bound of their error leave few pairs to sum."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        ld, rd = left["dim"].to_numpy(), right["dim"].to_numpy()
        lid, rid = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        for dim in np.intersect1d(ld, rd):
            at, to = np.flatnonzero(ld == dim), np.flatnonzero(rd == dim)
            q, x = matrix(left["v"].take(pa.array(at)), dim), matrix(right["v"].take(pa.array(to)), dim)
            a, b = q / np.abs(q).max(initial=1), x / np.abs(x).max(initial=1)
            s, error = a @ b.T, np.abs(a) @ np.abs(b).T * (dim + 4) * 2.0**-51 + 1e-290
            own = lid[at][:, None] == rid[to][None, :]
            sure = np.where(own, -np.inf, s - error)
            place = max(0, len(to) - k)
            least = np.partition(sure, place, axis=1)[:, place]
            i, j = np.nonzero((s + error >= least[:, None]) & ~own)
            rows, cols = {n: [int(c) for c in q[n]] for n in set(i.tolist())}, {n: [int(c) for c in x[n]] for n in set(j.tolist())}
            exact = [sum(c * d for c, d in zip(rows[m], cols[n], strict=True)) for m, n in zip(i.tolist(), j.tolist(), strict=True)]
            held = dict.fromkeys(rows, 0)
            for m, e, n in sorted(zip(i.tolist(), (-e for e in exact), rid[to[j]].tolist(), strict=True)):
                if held[m] < k:
                    held[m] += 1
                    for o, value in zip(out, (int(lid[at[m]]), n, Decimal(-e)), strict=True):
                        o.append(value)
        kinds = (pa.int64(), pa.int64(), pa.decimal128(38, 0))
        return pa.table([pa.array(o, kind) for o, kind in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return found


def pairwise(here: DataFrame, there: DataFrame, f, schema: str) -> DataFrame:
    there = there.select([F.col(c).alias(c) for c in there.columns])  # both sides stem from one table
    return here.groupBy("qb", "db").cogroup(there.groupBy("qb", "db")).applyInArrow(f, schema)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of every query with all other rows.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every``. Each round adds up, over all
    pairs of blocks, a histogram of every query's scores, finds the bin that holds the k-th value and cuts that bin into
    finer ones, until a bin is one score wide; the last pass returns the scores above the k-th value and, of the ties
    with it, the smallest ids. Every pass scores everything; only counts and the result leave the tasks.

    Queries whose scores could pass 2^61 are scored in one pass with integers of any length. score is a decimal if any found passes
    2^63; scores of more than 38 digits, which no column holds, end the query with an error.

    Vectors that are NULL or hold NULL or non-finite components take no part; an id
    names one vector, of repeated ids the smallest counts; vectors of different lengths are no candidates for each other.
    A query with fewer candidates returns all. No usable rows: an empty result.
    """
    # Whole numbers as doubles: from 2^53 on doubles are whole, and those beyond 2^63 are no longs.
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    v = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    rows = finite(vectors).select("vec_id", F.size("embedding").alias("dim"), v.alias("v"))
    rows = stage(rows, "topk-vectors")
    longest = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    # Scores lie within the sum of the query's magnitudes times the largest component; a little more, as doubles round.
    bound = longest * F.lit(largest) * (1 + 2.0**-30) + 1
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = asked.where(bound < WIDE)
    here, there = blocked(rows, queries)
    reach = bound.cast("long")
    state = queries.select("vec_id", (-reach).alias("low"), F.expr("0L").alias("above"), (2 * reach + 1).alias("span"))
    span = queries.agg(F.max(2 * reach + 1)).first()[0] or 1
    top = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    while span > 1:
        state = state.withColumn("width", F.expr(f"(span + {BINS - 1}) div {BINS}"))
        state = stage(state, "topk-state")
        counted = pairwise(here.join(state, "vec_id"), there, _histogram(k), "query_id long, bin long, n long")
        bins = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        higher = bins.withColumn("higher", F.sum("n").over(top.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        # The lowest bin kept that still has fewer than k scores above it holds the k-th value; with fewer than k scores in all, the lowest.
        held = higher.join(state.select(F.col("vec_id").alias("query_id"), "above"), "query_id").where(F.col("higher") + F.col("above") < k)
        held = held.groupBy("query_id").agg(F.min_by(F.struct("bin", "higher"), "bin").alias("b"))
        state = state.join(held, state.vec_id == held.query_id, "left").select(
            "vec_id", F.when(F.col("b").isNull(), F.col("low")).otherwise(F.col("low") + F.col("b.bin") * F.col("width")).alias("low"),
            (F.col("above") + F.coalesce("b.higher", F.lit(0))).alias("above"), F.col("width").alias("span"),
        )
        span = -(-span // BINS)
    state = stage(state, "topk-state")
    found = pairwise(here.join(state, "vec_id"), there, _select(k), "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    beyond = asked.where(bound >= WIDE)
    if beyond.isEmpty():
        return best(found)
    long = best(pairwise(*blocked(rows, beyond), _wide(k), "query_id long, vec_id long, score decimal(38,0)"))
    both = stage(best(found).withColumn("score", F.col("score").cast("decimal(38,0)")).unionByName(long), "topk-wide")
    fits = (both.agg(F.max(F.abs("score"))).first()[0] or 0) < 1 << 63
    return both.withColumn("score", F.col("score").cast("long")) if fits else both


def oracle(k: int = 5, every: int = 50, scale: int = 256) -> str:
    return f"""
WITH e AS (SELECT vec_id, min(embedding) AS embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           GROUP BY vec_id),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
