"""Row-level expressions: masks, power curve, wind angle, clock features, unit changes.

NULL is the only missing value. A comparison with NULL counts as false, so every mask term is coalesced.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed sensor limits of the fact table.
MIN_WORKING_WIND = 2.5
MAX_PITCH = 89
MAX_WDIR = 180
MAX_NDIR = 720
POWER_CAP = 1521.6
DAY_NORM = 200
MINUTES_PER_DAY = 1440
PITCH = ("pab1", "pab2", "pab3")


def known(term: Column) -> Column:
    return F.coalesce(term, F.lit(False))


def outside(col: str, limit: float) -> Column:
    return known(F.abs(F.col(col)) > limit)


def any_of(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for term in terms[1:]:
        out = out | term
    return out


def bad_pitch() -> Column:
    return any_of([known(F.col(c) > MAX_PITCH) for c in PITCH])


def bad_sensors() -> Column:
    return bad_pitch() | outside("wdir", MAX_WDIR) | outside("ndir", MAX_NDIR)


def idle_in_wind() -> Column:
    return known((F.col("patv") <= 0) & (F.col("wspd") > MIN_WORKING_WIND))


def abnormal_patv() -> Column:
    """Rows whose power is to be repaired."""
    return idle_in_wind() | bad_sensors()


def abnormal_eval() -> Column:
    """Rows left out of scoring: the repair mask and negative power."""
    return known(F.col("patv") < 0) | abnormal_patv()


def unknown_patv() -> Column:
    """Stricter mask of the short-horizon leg: zero power is bad at any wind, so is missing power."""
    return F.col("patv").isNull() | known(F.col("patv") <= 0) | bad_sensors()


def with_unknown_mask(df: DataFrame) -> DataFrame:
    """``mask`` 1 = usable, ``pab_mask`` 1 = pitch fine; power becomes NULL where the mask is 0."""
    return df.withColumns(
        {
            "mask": F.when(unknown_patv(), 0).otherwise(1),
            "pab_mask": F.when(bad_pitch(), 0).otherwise(1),
            "patv": F.when(~unknown_patv(), F.col("patv")),
        }
    )


def with_ndir_mask(df: DataFrame) -> DataFrame:
    bad = outside("ndir", MAX_NDIR)
    return df.withColumns({"abnormal_ndir": bad, "ndir": F.when(~bad, F.col("ndir"))})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Done once at ingest, so that no NaN reaches an aggregate."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def fill_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def clip_nonneg(df: DataFrame, cols: Sequence[str] = ("prtv", "patv")) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in cols})


def clip_capacity(col: Column, cap: float = POWER_CAP) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(0.0)), F.lit(cap)))


def unit_scale(df: DataFrame, cols: Sequence[str], divisor: float = POWER_CAP) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(divisor)) for c in cols})


def downcast_float(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Half the width for all numeric columns or the given ones (offered; the engine itself stays in double)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)] if cols is None else cols
    return df.withColumns({c: F.col(c).cast("float") for c in numeric})


def drop_prefixed(df: DataFrame, prefix: str = "abnormal_", also: Sequence[str] = PITCH) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)], *also)


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub("[^A-Za-z0-9_]+", "", c) for c in df.columns])


def power_curve(wspd: Column, a: Column, beta: Column, b: Column, mx: Column) -> Column:
    """Upper envelope of power at a wind speed; NULL where the curve or the wind is unknown."""
    raw = a * F.pow(wspd, beta) + b * wspd
    raw = F.when(~F.isnan(raw), raw)
    return F.when(raw.isNotNull() & mx.isNotNull(), F.least(raw, mx))


def with_curve(df: DataFrame, curve: DataFrame, how: str = "left") -> DataFrame:
    """Add the envelope ``max_patv``. No broadcast hint: Spark broadcasts the table while it is below its
    size threshold and sort-merges (with skew splitting) beyond."""
    params = curve.select("turb_id", "a", "beta", "b", "mx")
    return (
        df.join(params, "turb_id", how)
        .withColumn("max_patv", power_curve(*[F.col(c) for c in ("wspd", "a", "beta", "b", "mx")]))
        .drop("a", "beta", "b", "mx")
    )


def with_residual(df: DataFrame) -> DataFrame:
    return df.withColumn("patv_residual", F.col("max_patv") - F.col("patv"))


def clip_to_curve(df: DataFrame) -> DataFrame:
    """Flag power above the envelope (``mask2``), replace it, keep the original."""
    above = known(F.col("patv") > F.col("max_patv"))
    return df.withColumns(
        {
            "mask2": above,
            "origin_patv": F.col("patv"),
            "patv": F.when(above, F.col("max_patv")).otherwise(F.col("patv")),
        }
    )


def with_wind_angle(df: DataFrame, angle: DataFrame) -> DataFrame:
    out = df.join(angle.select("turb_id", "diff_angle"), "turb_id", "left")
    out = out.withColumn("w_angle", F.col("ndir") + F.col("wdir"))
    out = out.withColumn("w_angle_adj", F.col("w_angle") + F.col("diff_angle"))
    rad = F.radians("w_angle_adj")
    return out.withColumns({"w_angle_sin": F.sin(rad), "w_angle_cos": F.cos(rad)})


def minute_of_day(tmstamp: str = "tmstamp") -> Column:
    part = F.split(F.col(tmstamp), ":")
    return part[0].cast("bigint") * 60 + part[1].cast("bigint")


def with_clock(df: DataFrame) -> DataFrame:
    """``min_of_day``, ``minutes`` since day 1, and the position in the day as sine and cosine."""
    out = df.withColumn("min_of_day", minute_of_day())
    turn = F.lit(2.0) * F.pi() * F.col("min_of_day") / MINUTES_PER_DAY
    return out.withColumns(
        {
            "minutes": F.col("min_of_day") + (F.col("day") - 1) * MINUTES_PER_DAY,
            "sin_tm": F.sin(turn),
            "cos_tm": F.cos(turn),
            "day_norm": F.col("day") / DAY_NORM,
        }
    )


def time_key() -> Column:
    return F.concat_ws(",", F.col("day").cast("string"), F.col("tmstamp"))


def split_time_key(df: DataFrame, key: str = "tm") -> DataFrame:
    part = F.split(F.col(key), ",")
    return df.withColumns({"day": part[0].cast("bigint"), "tmstamp": part[1]})


def wind_bucket(wspd: Column) -> Column:
    """Half-metre buckets; calm and storm ends are pooled."""
    return F.when(wspd <= 2.5, 0.0).when(wspd >= 10, 10.0).otherwise(F.floor(wspd / 0.5) * 0.5)
