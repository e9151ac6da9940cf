"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolis.llm.common import stage, without

OWN = ("n_copies", "copy", "shuffle_key")
SEED = "mix-1"
#: Cap on a source's mean repetitions in the statement and where a caller names none; the query and the pipeline have no cap.
MAX_RATE = 8.0


def rates(docs: DataFrame, weights: DataFrame | None = None, max_rate: float | None = MAX_RATE) -> DataFrame:
    """Mean repetitions of every source: its share of the target over its share of the characters.

    ``weights`` (source, weight) names the target; without it the weight is the square root of a source's characters,
    which flattens the mixture. The target has as many characters as the corpus. A source without characters keeps rate 1;
    sources missing from ``weights`` get rate 0, weights of sources that the corpus lacks take no share. NULL is a source like any other.

    ``max_rate`` clips the rates, and what it clips is lost: the result is shorter than the corpus then. With None every source reaches its share.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt("chars"))
    else:
        w = weights.groupBy(F.col("source").alias("of")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sizes.join(w, sizes.source.eqNullSafe(w.of), "left").select("source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = stage(weighed, "mix-weights")
    all_chars, all_weight = weighed.agg(F.sum("chars"), F.sum("weight")).first()
    rate = F.col("weight") / F.nullif(F.lit(all_weight), F.lit(0.0)) * F.lit(all_chars) / F.col("chars")
    known = F.coalesce(rate, F.lit(0.0))
    clipped = F.when(F.col("chars") > 0, known if max_rate is None else F.least(known, F.lit(max_rate))).otherwise(1.0)
    return weighed.select("source", clipped.alias("rate"))


def uniform(text) -> F.Column:
    """52 bits of an md5 as a number in [0, 1); the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def distribution(rate: float) -> tuple[int, np.ndarray]:
    """First count and the Poisson distribution function from there on; what lies outside is less than a uniform number can tell."""
    reach = 12 * math.sqrt(rate) + 24
    low, high = max(0, int(rate - reach)), int(rate + reach)
    if low == 0:
        steps = np.concatenate([[math.exp(-rate)], rate / np.arange(1, high + 1)])
        return 0, np.cumsum(np.cumprod(steps))
    # Relative to the likeliest count, as exp(-rate) is too small for a double; long sources of error cancel in the sum.
    k = np.arange(low, high + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(rate / k[1:]))])
    p = np.exp(logs - logs.max())
    return low, np.cumsum(p) / p.sum()


def _distributions(batches):
    for b in batches:
        found = [distribution(r) for r in b["rate"].to_pylist()]
        yield pa.record_batch([b["_of"], pa.array([low for low, _ in found], pa.int32()), pa.array([c.tolist() for _, c in found], pa.list_(pa.float64()))], ["_of", "_least", "_cdf"])


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED, max_rate: float | None = MAX_RATE) -> DataFrame:
    """Repeat every document a Poisson number of times with its source's mean rate, in a random global order.

    The count is the inverse of the Poisson distribution function at a uniform number hashed from the seed and the document's
    id, so a lost task draws the same again. Returns the documents' columns with ``n_copies``, ``copy`` (from 1) and
    ``shuffle_key``; rows are dealt to partitions by that hash and sorted by it inside, which is a random permutation.

    Columns of these names in the input are replaced, other columns are kept. NULL text counts as empty. Without an id a document
    draws by its text. Repeated rows are copies of one document and draw alike. An empty table gives an empty result.
    """
    base = without(docs, [*OWN, "_salt", "_key", "_cdf", "_least", "_of", "_name"]).withColumn("_salt", F.monotonically_increasing_id() % 4096)
    # Written, so that Spark knows its size: broadcast while small, else a sort-merge join whose hot source is split.
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # NULL is a source of its own
    known = rates(base, weights, max_rate).select(named.alias("_of"), "rate")
    table = stage(known.mapInArrow(_distributions, "_of string, _least int, _cdf array<double>"), "mix-rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    drawn = base.withColumn("_key", key).withColumn("_name", named).join(table, F.col("_name") == F.col("_of"))
    drawn = drawn.withColumn("n_copies", F.col("_least") + F.size(F.filter("_cdf", lambda c: c <= uniform(F.concat(F.lit(f"{seed}:"), F.col("_key"))))))
    copies = drawn.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    placed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:shuffle"), "_key", "copy").cast("binary")))
    dealt = placed.repartition("shuffle_key", "_salt").sortWithinPartitions("shuffle_key")
    return without(dealt, ["_salt", "_key", "_cdf", "_least", "_of", "_name"])


def oracle(seed: str = SEED, max_rate: float = MAX_RATE) -> str:
    steps = int(max_rate + 12 * math.sqrt(max_rate) + 24)
    return f"""
WITH s AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN chars > 0 THEN least(sqrt(chars) / (SELECT sum(sqrt(chars)) FROM s) * (SELECT sum(chars) FROM s) / chars, {max_rate})
                          ELSE 1.0 END AS rate FROM s),
p AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1.0)) END AS p
      FROM r, (SELECT unnest(range(0, {steps} + 1)) AS k) g),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
l AS (SELECT source, list(cdf) AS cdf FROM c GROUP BY source),
u AS (SELECT d.*, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT)
                  / CAST({1 << 52} AS DOUBLE) AS u FROM documents d),
n AS (SELECT u.* EXCLUDE (u), CAST(len(list_filter(l.cdf, lambda x: x <= u.u)) AS INTEGER) AS n_copies
      FROM u JOIN l ON u.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(copy AS INTEGER) AS copy,
       md5('{seed}:shuffle:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n)"""
