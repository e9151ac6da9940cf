"""Repair of abnormal readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolis.functions.scalar import abnormal_patv, known, wind_bucket
from aeolis.operators.blocks import CARRY_BLOCK, block_id
from aeolis.operators.farm import TIME, group_percentiles, join_time


def repair_sigma(df: DataFrame, col: str = "etmp", keys: Sequence[str] = TIME, sigmas: float = 3) -> DataFrame:
    """Values beyond ``sigmas`` standard deviations of the farm at that time become the farm median."""
    stats = group_percentiles(
        df, keys, {"_med": (col, 0.5)}, {"_mean": F.avg(col), "_std": F.stddev_samp(col)}
    )
    away = F.abs(F.col(col) - F.col("_mean")) > sigmas * F.col("_std")
    out = join_time(df, stats, keys).withColumn(f"abnormal_{col}", known(away))
    return out.withColumn(col, F.when(F.col(f"abnormal_{col}"), F.col("_med")).otherwise(F.col(col))).drop(
        "_med", "_mean", "_std"
    )


def temperature_percentiles(
    df: DataFrame,
    ub: float = 0.85,
    lb: float = 0.15,
    keys: Sequence[str] = TIME,
    low: float = -20,
    high: float = 50,
    **kw,
) -> DataFrame:
    """Median and both bounds of the two temperatures, over turbines with a plausible outside temperature."""
    wanted = {
        f"{c}_{name}": (c, p) for c in ("etmp", "itmp") for name, p in (("median", 0.5), ("ub", ub), ("lb", lb))
    }
    return group_percentiles(df.filter(F.col("etmp").between(low, high)), keys, wanted, **kw)


def repair_temperature(df: DataFrame, ub: float = 0.85, lb: float = 0.15, keys: Sequence[str] = TIME) -> DataFrame:
    """Temperatures outside the percentile band become the farm median; originals and medians stay."""
    out = join_time(df, temperature_percentiles(df, ub, lb, keys), keys)
    out = out.withColumns({f"origin_{c}": F.col(c) for c in ("etmp", "itmp")})
    fixed = {
        c: F.when(known(~F.col(c).between(F.col(f"{c}_lb"), F.col(f"{c}_ub"))), F.col(f"{c}_median")).otherwise(
            F.col(c)
        )
        for c in ("etmp", "itmp")
    }
    return out.withColumns(fixed).drop(*[f"{c}_{b}" for c in ("etmp", "itmp") for b in ("ub", "lb")])


def normal_pool(df: DataFrame, size: int = CARRY_BLOCK) -> DataFrame:
    """Usable power values per wind bucket, numbered 0..n-1 in (turb_id, slot) order.

    One bucket may hold a third of all rows, so rows are numbered inside (bucket, turbine, block of slots) and the
    group sizes, one row per group, supply the offsets.
    """
    keys = ["ws_bucket", "turb_id", "_blk"]
    rows = df.filter("mask = 1").select(
        wind_bucket(F.col("wspd")).alias("ws_bucket"), "turb_id", block_id("slot", size).alias("_blk"), "slot", "patv"
    )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("slot")))
    return numbered.join(_offsets(sizes), keys).select(
        "ws_bucket", (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias("rn"), "patv"
    )


def _offsets(sizes: DataFrame) -> DataFrame:
    """Offset of each (bucket, turbine, block): the bucket's turbines before it, then the turbine's blocks before it."""
    earlier = (Window.unboundedPreceding, -1)
    turb = sizes.groupBy("ws_bucket", "turb_id").agg(F.sum("_n").alias("_tn"))
    turb = turb.withColumn(
        "_t_off", F.sum("_tn").over(Window.partitionBy("ws_bucket").orderBy("turb_id").rowsBetween(*earlier))
    )
    blocks = sizes.withColumn(
        "_b_off", F.sum("_n").over(Window.partitionBy("ws_bucket", "turb_id").orderBy("_blk").rowsBetween(*earlier))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return blocks.join(turb, ["ws_bucket", "turb_id"]).select(
        "ws_bucket", "turb_id", "_blk", (zero("_t_off") + zero("_b_off")).alias("_off")
    )


def resample_noisy(df: DataFrame, pool: DataFrame, seed: int | None = 0, draw=None) -> DataFrame:
    """Unusable rows get the power of a random usable row at similar wind speed.

    The draw is a hash of the row key, so a re-run task draws the same value. The bucket sizes are one small
    aggregate; the draw joins on (bucket, number), which spreads even a bucket that holds most rows.
    ``draw`` replaces the hash (an integer column).
    """
    pick = F.xxhash64("turb_id", "slot", F.lit(seed)) if draw is None else draw
    sizes = pool.groupBy("ws_bucket").agg(F.count(F.lit(1)).alias("_size"))
    out = df.withColumn("ws_bucket", wind_bucket(F.col("wspd"))).join(sizes, "ws_bucket", "left")
    # rows that draw nothing get a number of their own below zero: one shared NULL would be a hot join key
    number = F.when(F.col("mask") == 0, F.pmod(pick, F.col("_size"))).otherwise(-1 - F.col("slot"))
    out = out.withColumn("_rn", number)
    donors = pool.select("ws_bucket", F.col("rn").alias("_rn"), F.col("patv").alias("_donor"))
    return (
        out.join(donors, ["ws_bucket", "_rn"], "left")
        .withColumn("patv", F.when(F.col("mask") == 0, F.col("_donor")).otherwise(F.col("patv")))
        .drop("_rn", "_size", "_donor")
    )


def overwrite_abnormal(scored: DataFrame, prediction: str = "prediction", flag: Column | None = None) -> DataFrame:
    """Abnormal power becomes the model's prediction; other rows stay as they are.

    ``flag`` is the mask of the readings as delivered, if they have been changed since.
    """
    bad = abnormal_patv() if flag is None else flag
    return scored.withColumn("patv", F.when(bad, F.col(prediction)).otherwise(F.col("patv"))).drop(prediction)


def overwrite_unknown(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Power of unusable rows becomes the prediction; all power is kept between 0 and the power curve."""
    filled = F.when(F.col("mask") == 0, F.col(prediction)).otherwise(F.col("patv"))
    lower = F.when(filled < 0, F.lit(0.0)).otherwise(filled)
    capped = F.when(lower > F.col("max_patv"), F.col("max_patv")).otherwise(lower)
    return scored.withColumn("patv", capped).drop(prediction)
