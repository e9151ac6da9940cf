"""Accuracy measures on rows (y, yhat [, mask]); plain ones are single aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolis.operators.blocks import ENTITY
from aeolis.operators.rolling import trailing

UNIT = 1000.0
EMPTY = 0.0001


def _err() -> Column:
    return F.col("yhat") - F.col("y")


def mae() -> Column:
    return F.avg(F.abs(_err()))


def mse() -> Column:
    return F.avg(_err() * _err())


def rmse() -> Column:
    return F.sqrt(mse())


def mape() -> Column:
    return F.avg(F.abs(F.try_divide(_err(), F.col("y"))))


def mspe() -> Column:
    ratio = F.try_divide(_err(), F.col("y"))
    return F.avg(ratio * ratio)


def rse() -> Column:
    """Root of the squared error relative to that of the mean."""
    return F.sqrt(F.sum(_err() * _err())) / F.sqrt(F.var_pop("y") * F.count("y"))


def bundle() -> list[Column]:
    return [f().alias(n) for n, f in (("mae", mae), ("mse", mse), ("rmse", rmse), ("mape", mape), ("mspe", mspe))]


def corr_product(df: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """Mean over columns of sum(dy*dp) / sqrt(sum(dy^2*dp^2)). The denominator sums the product of the squares, so
    this is not Pearson's coefficient; ``corr`` gives that one."""
    means = df.groupBy(*by).agg(F.avg("y").alias("_my"), F.avg("yhat").alias("_mp"))
    d = df.join(means, list(by)).withColumns({"_dy": F.col("y") - F.col("_my"), "_dp": F.col("yhat") - F.col("_mp")})
    prod = F.col("_dy") * F.col("_dp")
    per = d.groupBy(*by).agg(F.try_divide(F.sum(prod), F.sqrt(F.sum(prod * prod))).alias("c"), F.corr("y", "yhat").alias("r"))
    return per.agg(F.avg("c").alias("corr_product"), F.avg("r").alias("corr"))


def score_windows(
    df: DataFrame, horizon: int, entity: Sequence[str] = ENTITY, pos: str = "time"
) -> DataFrame:
    """Per entity and sliding window of ``horizon`` rows (named by its last row): MAE and RMSE in megawatts over the
    normal rows; NULL where there is none."""
    normal = ~F.col("abnormal")
    e = (F.col("yhat") - F.col("y")) / UNIT
    parts = df.select(
        *entity,
        pos,
        F.when(normal, 1.0).otherwise(0.0).alias("_n"),
        F.when(normal, F.abs(e)).otherwise(0.0).alias("_a"),
        F.when(normal, e * e).otherwise(0.0).alias("_q"),
    )
    sums = trailing(parts, {"n": ("sum", "_n"), "a": ("sum", "_a"), "q": ("sum", "_q")}, horizon, entity, pos)
    return sums.filter(F.col("n").isNotNull()).select(
        *entity,
        pos,
        F.try_divide("a", "n").alias("mae"),
        F.sqrt(F.try_divide("q", "n")).alias("rmse"),
    )


def score_sliding(
    df: DataFrame, horizon: int, stride: int = 1, entity: Sequence[str] = ENTITY, pos: str = "time"
) -> DataFrame:
    """Contest score: sums over turbines, means over windows, mean of MAE and RMSE. Abnormal rows are excluded."""
    w = score_windows(df, horizon, entity, pos)
    w = w.filter((F.col(pos) - (horizon - 1)) % stride == 0)
    per = w.groupBy(pos).agg(
        F.coalesce(F.sum("mae"), F.lit(0.0)).alias("mae"), F.coalesce(F.sum("rmse"), F.lit(0.0)).alias("rmse")
    )
    return per.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")).withColumn(
        "score", (F.col("mae") + F.col("rmse")) / 2
    )


def _masked(df: DataFrame, length: Column, sample: Sequence[str]) -> DataFrame:
    e = (F.col("y") - F.col("yhat")) / UNIT
    return df.groupBy(*sample, "turb_id").agg(
        F.sqrt(F.sum(e * e * F.col("mask")) / length).alias("rmse"),
        (F.sum(F.abs(e) * F.col("mask")) / length).alias("mae"),
    )


def score_fixed_len(df: DataFrame, horizon: int, sample: Sequence[str] = ()) -> DataFrame:
    """Masked errors divided by the fixed horizon; total summed over turbines, parts averaged over them."""
    per = _masked(df, F.lit(float(horizon)), sample)
    total = per.groupBy(*sample).agg(F.sum(0.5 * F.col("rmse") + 0.5 * F.col("mae")).alias("s"), F.sum("rmse").alias("r"), F.sum("mae").alias("m"), F.count(F.lit(1)).alias("k"))
    return total.agg(
        F.avg("s").alias("score"), (F.sum("r") / F.sum("k")).alias("rmse"), (F.sum("m") / F.sum("k")).alias("mae")
    )


def score_masked_len(df: DataFrame, sample: Sequence[str] = ()) -> DataFrame:
    """Masked errors divided by the number of usable rows; everything summed over turbines."""
    per = _masked(df, F.sum("mask") + EMPTY, sample)
    total = per.groupBy(*sample).agg(F.sum(0.5 * F.col("rmse") + 0.5 * F.col("mae")).alias("s"), F.sum("rmse").alias("r"), F.sum("mae").alias("m"))
    return total.agg(F.avg("s").alias("score"), F.avg("r").alias("rmse"), F.avg("m").alias("mae"))


def loss_masked_mean() -> Column:
    e = F.col("yhat") - F.col("y")
    return F.sum(e * e * F.col("mask")) / (F.sum("mask") + EMPTY)


def masked_loss() -> Column:
    """Mean squared error with both sides multiplied by the mask (all rows count)."""
    e = (F.col("y") - F.col("yhat")) * F.col("mask")
    return F.avg(e * e)


def two_part_loss(loss: Column, loss2: Column, epoch: int, weight: float = 0.2) -> Column:
    """Second part fades by a tenth per epoch."""
    w = weight * 0.9**epoch
    return (1 - w) * loss + w * loss2


def total_power_error(df: DataFrame, sample: Sequence[str] = ()) -> DataFrame:
    """Errors of the farm total: sum turbines first, then RMSE and MAE per sample, then their means."""
    per_step = df.groupBy(*sample, "step").agg((F.sum("y") / UNIT).alias("y"), (F.sum("yhat") / UNIT).alias("yhat"))
    per_sample = per_step.groupBy(*sample).agg(rmse().alias("rmse"), mae().alias("mae"))
    return per_sample.agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
