"""A normaliser for every sample: fitted on the sample's inputs, applied to its inputs and to the steps that follow.

A normaliser is a table of single numbers, one row a sample (and column). Samples are never stored: a block of anchors meets the
values that its samples reach, and each value is scaled once for every sample that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeolis.operators.blocks import BLOCK, ENTITY, block_id, with_halo
from aeolis.operators.hierarchy import node_of_turbine
from aeolis.operators.split_scale import adaptive_norm


def node_norm(values: DataFrame, edges: DataFrame, input_len: int, col: str = "patv", farm: str = "farm_id") -> DataFrame:
    """(farm, node, anchor, mean, std) for every turbine and group, as :func:`adaptive_norm` has them: turbines share the
    pooled statistics of the sample's inputs."""
    norm = adaptive_norm(values, edges, input_len, col, farm).withColumnRenamed("slot", "anchor")
    turbines = values.select(farm, node_of_turbine().alias("node"), F.col("slot").alias("anchor"))
    pooled = norm.filter("node = 'base'").drop("node")
    return turbines.join(pooled, [farm, "anchor"]).unionByName(norm.filter("node <> 'base'"))


def column_norm(
    df: DataFrame,
    cols: Sequence[str],
    input_len: int,
    entity: Sequence[str] = ENTITY,
    pos: str = "slot",
    size: int = BLOCK,
) -> DataFrame:
    """(entity, anchor, feature, mean, std): mean and population deviation of the known inputs of every sample and column.

    ``pos`` must be gap-free. A window without any known value has neither; the first full window is the first sample.
    """
    narrow = df.select(*entity, pos, *[F.col(c).cast("double").alias(c) for c in cols])
    haloed = with_halo(narrow, pos, size, back=input_len - 1)
    fields = [T.StructField(n, k) for n, k in (("anchor", T.LongType()), ("feature", T.StringType()), ("mean", T.DoubleType()), ("std", T.DoubleType()))]
    schema = T.StructType([*[narrow.schema[e] for e in entity], *fields])

    def fit(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(pos, kind="stable")
        full = block["_own"].to_numpy() & (np.arange(len(block)) >= input_len - 1)
        keys = block.loc[full, list(entity)].assign(anchor=block.loc[full, pos])
        parts = []
        for c in cols:
            window = block[c].astype("float64").rolling(input_len, min_periods=1)
            parts.append(keys.assign(feature=c, mean=window.mean()[full], std=window.std(ddof=0)[full]))
        return pd.concat(parts)[schema.names]

    return haloed.groupBy(*entity, "_blk").applyInPandas(fit, schema)


def scale_samples(
    series: DataFrame,
    norm: DataFrame,
    input_len: int,
    output_len: int,
    entity: Sequence[str],
    pos: str = "slot",
    col: str = "value",
    size: int = 256,
) -> DataFrame:
    """(entity, anchor, offset, col): (value - mean) / std of the sample, offsets 1 - ``input_len`` to 0 its inputs, 1 to
    ``output_len`` the steps behind them.

    ``norm`` holds (entity, anchor, mean, std). Only samples whose last step exists are returned; with ``output_len`` 0, as for a
    forecast, all. A sample without deviation has NULLs, as unknown values have.
    """
    last = series.groupBy(*entity).agg(F.max(pos).alias("_last"))
    fitted = norm.select(*entity, "anchor", "mean", "std").join(last, list(entity))
    whole = fitted.filter(F.col("anchor") + output_len <= F.col("_last")).withColumn("_blk", block_id("anchor", size))
    reached = with_halo(series.select(*entity, pos, col), pos, size, back=input_len - 1, ahead=output_len).drop("_own")
    offset = F.col(pos) - F.col("anchor")
    held = reached.join(whole, [*entity, "_blk"]).filter(offset.between(1 - input_len, output_len))
    scaled = F.try_divide(F.col(col) - F.col("mean"), F.col("std"))
    return held.select(*entity, "anchor", offset.alias("offset"), scaled.alias(col))


def unscale_samples(preds: DataFrame, norm: DataFrame, entity: Sequence[str], col: str = "yhat") -> DataFrame:
    """Predictions of scaled samples back in the units of their normaliser."""
    fitted = norm.select(*entity, "anchor", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    back = preds.join(fitted, [*entity, "anchor"], "left")
    return back.withColumn(col, F.col(col) * F.col("_std") + F.col("_mean")).drop("_mean", "_std")
