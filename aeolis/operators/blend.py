"""Forecast tables (model_id, turb_id, step, yhat): segments, medians, corrections, blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolis.operators.blocks import ENTITY


def horizon_segments(models: DataFrame) -> DataFrame:
    """From (model_id, output_len): each model serves the steps from the next shorter length to its own.

    Distinct lengths are bounded by the horizon, so they are ordered as one small array.
    """
    lengths = models.agg(F.array_sort(F.collect_set("output_len")).alias("ls"))
    pairs = lengths.select(F.posexplode("ls").alias("i", "output_len"), "ls").select(
        "output_len", F.when(F.col("i") > 0, F.get("ls", F.col("i") - 1)).otherwise(0).cast("bigint").alias("seg_start")
    )
    return models.join(pairs, "output_len").select(
        "model_id", "seg_start", F.col("output_len").alias("seg_end")
    )


def segment_members(preds: DataFrame, segments: DataFrame) -> DataFrame:
    """Forecast rows a model contributes: those of its own segment."""
    return preds.join(segments, "model_id").filter(
        (F.col("step") >= F.col("seg_start")) & (F.col("step") < F.col("seg_end"))
    )


def segment_median(preds: DataFrame, segments: DataFrame) -> DataFrame:
    """Median over the members of each segment; the segments do not overlap, so together they are the forecast."""
    return (
        segment_members(preds, segments)
        .groupBy("turb_id", "step", "seg_start", "seg_end")
        .agg(F.median("yhat").alias("yhat"))
    )


def segment_concat(preds: DataFrame, segments: DataFrame) -> DataFrame:
    return segment_median(preds, segments).select("turb_id", "step", "yhat")


def last_k_median(history: DataFrame, k: int, col: str = "patv") -> DataFrame:
    """Median per turbine over the last ``k`` times at which any turbine reported, missing values skipped."""
    times = history.filter(F.col(col).isNotNull()).select("slot").distinct().orderBy(F.desc("slot")).limit(k)
    since = times.agg(F.min("slot")).scalar()
    recent = history.filter(F.col("slot") >= since)
    return recent.groupBy("turb_id").agg(F.median(col).alias("last"))


def anchor_adjust(preds: DataFrame, history: DataFrame, fade: int = 60, lookback: int = 10) -> DataFrame:
    """Pull the first ``fade`` steps towards the last known power, with a quadratically vanishing weight."""
    last = last_k_median(history, lookback)
    gap = F.coalesce(F.col("last") - F.col("yhat"), F.lit(0.0))
    weight = F.pow((F.col("step") - fade) / float(fade), 2)
    return (
        preds.join(last, "turb_id", "left")
        .withColumn("yhat", F.when(F.col("step") < fade, F.col("yhat") + gap * weight).otherwise(F.col("yhat")))
        .drop("last")
    )


def lookback_means(
    df: DataFrame, horizon: int, lookback: int, entity: Sequence[str] = ENTITY, pos: str = "time"
) -> DataFrame:
    """For each block of ``horizon`` rows but the first: mean target and prediction over the normal ones of the
    ``lookback`` rows before it, and the share of abnormal rows.

    Those rows end the previous block, so this is one aggregate keyed by (entity, block), without a window.
    """
    tail = df.filter(F.col(pos) % horizon >= horizon - lookback)
    normal = ~F.col("abnormal")
    return tail.groupBy(*entity, (F.floor(F.col(pos) / horizon) + 1).alias("block")).agg(
        F.avg(F.when(normal, F.col("target"))).alias("mean_true"),
        F.avg(F.when(normal, F.col("pred_target"))).alias("mean_pred"),
        (F.sum(F.col("abnormal").cast("int")) / float(lookback)).alias("abnormal_share"),
    )


def residual_decay_adjust(
    df: DataFrame,
    horizon: int,
    lookback: int = 10,
    zero_at: int = 75,
    max_abnormal: float = 0.6,
    additive: bool = False,
    entity: Sequence[str] = ENTITY,
    pos: str = "time",
) -> DataFrame:
    """Replace each block after the first by a curve from the recent truth to the mean prediction.

    ``additive`` keeps the block's own prediction and adds the vanishing residual to it instead.
    """
    stats = lookback_means(df, horizon, lookback, entity, pos)
    out = df.withColumn("block", F.floor(F.col(pos) / horizon)).join(stats, [*entity, "block"], "left")
    t = F.col(pos) % horizon
    weight = F.pow(F.greatest(F.lit(zero_at) - t, F.lit(0)) / float(zero_at), 2)
    residual = weight * (F.col("mean_true") - F.col("mean_pred"))
    base = F.col("pred_target") if additive else F.col("mean_pred")
    return out.withColumn(
        "pred_target",
        F.when(F.col("abnormal_share") < max_abnormal, base + residual).otherwise(F.col("pred_target")),
    ).drop("block", "mean_true", "mean_pred", "abnormal_share")


def blend_legs(short: DataFrame, long: DataFrame, start: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(by, turb_id, step, yhat): the short-horizon leg alone before ``start``, the mean of both legs from there on, or the one that is known.

    Steps that only one leg has stay. ``by`` names further keys, such as the model.
    """
    keys = [*by, "turb_id", "step"]
    here, other = short.select(*keys, F.col("yhat").alias("_own")), long.select(*keys, F.col("yhat").alias("_other"))
    mean = F.when(F.col("step") >= start, 0.5 * F.col("_own") + 0.5 * F.col("_other"))
    return here.join(other, keys, "full").select(*keys, F.coalesce(mean, "_own", "_other").alias("yhat"))


def flatness(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over turbines of the std over time, and mean over time of the std over turbines, for each of ``by``."""
    spread = lambda key, name: preds.groupBy(*by, key).agg(F.stddev_pop("yhat").alias("s")).groupBy(*by).agg(F.avg("s").alias(name))
    over_time, over_turbines = spread("turb_id", "std_time"), spread("step", "std_turbines")
    if by:
        return over_turbines.join(over_time, list(by))
    return over_turbines.withColumn("std_time", over_time.scalar())


def add_jitter(
    preds: DataFrame,
    sigma: float = 0.015,
    seed: int = 0,
    only_if_flat: float | None = None,
    draws: tuple[Column, Column] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Small normal noise, so that a forecast is never perfectly flat.

    The noise comes from a hash of the row key by the Box-Muller rule: a re-run task repeats it exactly. ``draws`` replaces
    the hashes by two columns in (0, 1], for the radius and the angle.
    ``only_if_flat`` adds it only where the mean std (over time or over turbines) is at most that value. ``by`` names further
    keys, such as the model, each of which has draws and a flatness of its own.
    """
    unit = lambda salt: (F.pmod(F.xxhash64(*by, "turb_id", "step", F.lit(seed), F.lit(salt)), F.lit(2**52)) + 1) / F.lit(
        2.0**52 + 1
    )
    radius, angle = draws or (unit("radius"), unit("angle"))
    noise: Column = F.sqrt(-2 * F.log(radius)) * F.cos(2 * F.pi() * angle) * sigma
    if only_if_flat is not None:
        flat = flatness(preds, by).select(*by, (F.least("std_time", "std_turbines") <= only_if_flat).alias("_flat"))
        if by:
            preds = preds.join(flat, list(by), "left")
        noise = F.when(F.col("_flat") if by else flat.scalar(), noise).otherwise(F.lit(0.0))
        return preds.withColumn("yhat", F.col("yhat") + noise).drop("_flat")
    return preds.withColumn("yhat", F.col("yhat") + noise)


def forecast_layout(preds: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per turbine (and ``by``) with the forecast as an array in step order (bounded by the horizon)."""
    inside = preds.filter((F.col("step") >= 0) & (F.col("step") < steps))
    cell = F.array_sort(F.collect_list(F.struct("step", "yhat")))
    return inside.groupBy(*by, "turb_id").agg(cell.alias("c")).select(*by, "turb_id", F.col("c.yhat").alias("forecast"))
