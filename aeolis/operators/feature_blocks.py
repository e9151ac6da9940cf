"""All windowed columns of the long-horizon leg from one exchange.

A block of a series meets its neighbours on both sides once: the rows before it feed the trailing statistics and the series
features, those behind it the label. Nothing is joined, so the wide rows move a single time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aeolis.operators.blocks import ENTITY, spread, with_halo
from aeolis.operators.rolling import bundle_specs, roll_block
from aeolis.operators.series import SERIES_FEATURES, feature_names, strided_features


def long_leg_blocks(
    df: DataFrame,
    features: Sequence[str],
    roll: int,
    series: int,
    horizon: int,
    entity: Sequence[str] = ENTITY,
    pos: str = "time",
    size: int = 2048,
) -> DataFrame:
    """Rows with a full window of ``series`` rows, with the rolling bundle of ``features``, ``seasonal_patv``, the series
    features of ``patv``, ``target`` (power ``horizon`` rows later, NULL at a series' end) and ``abnormal`` moved along with it.

    Equal to the inner join of ``roll_bundle``, ``series_features`` and ``with_label``. ``pos`` must be a gap-free row position.
    """
    specs = bundle_specs(features, [roll])
    level = f"win{roll}_mean_patv"
    names = [n for n in feature_names(SERIES_FEATURES, series) if n != "linear_trend__statistic"]
    haloed = with_halo(df, pos, size, back=max(roll, series) - 1, ahead=horizon)
    fields = [f for f in haloed.schema.fields if f.name not in ("_blk", "_own")]
    added = [*specs, *(["seasonal_patv"] if level in specs else []), *[f"patv__{n}" for n in names], "target"]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in added]])
    moved = "abnormal" in df.columns

    def compute(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(pos, kind="stable").reset_index(drop=True)
        chosen = np.flatnonzero(block["_own"].to_numpy() & (np.arange(len(block)) >= series - 1))
        new = {o: v.to_numpy()[chosen] for o, v in roll_block(block, specs).items()}
        power = block["patv"].astype("float64")
        if level in specs:
            new["seasonal_patv"] = power.to_numpy()[chosen] - new[level]
        new["target"] = power.shift(-horizon).to_numpy()[chosen]
        views = strided_features(power, series, chosen - (series - 1), SERIES_FEATURES)
        new |= {f"patv__{n}": views[n] for n in names}
        if moved:
            block["abnormal"] = block["abnormal"].astype(object).shift(-horizon)
        kept = block.iloc[chosen].reset_index(drop=True)
        return pd.concat([kept, pd.DataFrame(new)], axis=1)[schema.names]

    return spread(haloed, *entity, "_blk").groupBy(*entity, "_blk").applyInPandas(compute, schema)
