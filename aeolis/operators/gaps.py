"""Completion of the time grid and filling of gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolis.functions.scalar import with_clock
from aeolis.operators.blocks import BLOCK, CARRY_BLOCK, ENTITY, block_id, neighbours, spread


def _with_slots(df: DataFrame, first, last, size: int = BLOCK) -> DataFrame:
    """One row per slot first..last, unrolled in two steps so that no single array grows with the series."""
    out = df.withColumns({"_first": first, "_last": last})
    out = out.withColumn("_blk", F.explode(F.sequence(F.floor(F.col("_first") / size), F.floor(F.col("_last") / size))))
    # a fixed partition count, so that the tiny block rows are not merged into one task before they unroll
    out = spread(out, *[c for c in ("turb_id",) if c in out.columns], "_blk")
    begin = F.greatest(F.col("_blk") * size, F.col("_first"))
    end = F.least((F.col("_blk") + 1) * size - 1, F.col("_last"))
    return out.withColumn("slot", F.explode(F.sequence(begin, end))).drop("_first", "_last", "_blk")


def time_grid(df: DataFrame, steps_per_day: int, size: int = BLOCK) -> DataFrame:
    """Every step between the first and the last time seen, with its day number and clock."""
    span = df.agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))
    return calendar(_with_slots(span, F.col("_lo"), F.col("_hi"), size).drop("_lo", "_hi"), steps_per_day)


def calendar(df: DataFrame, steps_per_day: int) -> DataFrame:
    """Day (from 1) and 'HH:MM' of a slot."""
    minute = (F.col("slot") % steps_per_day) * (1440 // steps_per_day)
    clock = F.concat(
        F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0")
    )
    return df.withColumns({"day": F.floor(F.col("slot") / steps_per_day) + 1, "tmstamp": clock})


def slot_of(steps_per_day: int) -> Column:
    """Dense step number of (day, tmstamp)."""
    part = F.split("tmstamp", ":")
    minute = part[0].cast("bigint") * 60 + part[1].cast("bigint")
    return ((F.col("day") - 1) * steps_per_day + F.floor(minute / (1440 // steps_per_day))).cast("bigint")


def turbine_grid(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Every (turbine, slot). Each turbine unrolls the common range itself; no product of two tables is formed."""
    span = df.agg(F.struct(F.min("slot").alias("lo"), F.max("slot").alias("hi")).alias("span"))
    turbines = df.select("turb_id").distinct().withColumn("_span", span.scalar())
    return _with_slots(turbines, F.col("_span.lo"), F.col("_span.hi"), size).drop("_span")


def fill_missing_slots(df: DataFrame, steps_per_day: int, size: int = BLOCK) -> DataFrame:
    """Complete grid left-joined to the data: missing cells become NULL rows."""
    grid = calendar(turbine_grid(df, size), steps_per_day)
    extra = [c for c in ("day", "tmstamp", "hour") if c in df.columns]
    return grid.join(df.drop(*extra), ["turb_id", "slot"], "left")


def interpolate(
    df: DataFrame,
    col: str,
    entity: Sequence[str] = ENTITY,
    pos: str = "time",
    size: int = CARRY_BLOCK,
    edges: bool = True,
) -> DataFrame:
    """Linear by row position between known neighbours. With ``edges``, leading gaps take the next value and
    trailing gaps the last; else they stay."""
    out = neighbours(df, [col], entity, pos, size)
    prev, nxt = F.col(f"_prev_{col}"), F.col(f"_next_{col}")
    share = (F.col(pos) - prev["pos"]) / (nxt["pos"] - prev["pos"])
    line = prev["value"] + share * (nxt["value"] - prev["value"])
    value = (
        F.when(F.col(col).isNotNull(), F.col(col))
        .when(prev.isNotNull() & nxt.isNotNull(), line)
        .otherwise(F.coalesce(nxt["value"], prev["value"]) if edges else F.lit(None))
    )
    return out.withColumn(col, value).drop(f"_prev_{col}", f"_next_{col}")


def fill_time_order(
    df: DataFrame, cols: Sequence[str], entity: Sequence[str] = ENTITY, pos: str = "slot", size: int = CARRY_BLOCK
) -> DataFrame:
    """Backward then forward fill along time, per entity."""
    out = neighbours(df, cols, entity, pos, size)
    filled = {c: F.coalesce(f"_next_{c}.value", f"_prev_{c}.value") for c in cols}
    return out.withColumns(filled).drop(*[f"_{s}_{c}" for s in ("prev", "next") for c in cols])


def fill_row_order(
    df: DataFrame, cols: Sequence[str], farm: Sequence[str] = ("farm_id",), size: int = CARRY_BLOCK
) -> DataFrame:
    """Backward then forward fill over rows ordered by (slot, turb_id) within a farm.

    A gap takes the next turbine of the same time, else the first known turbine of a later time. The same-time
    step is blocked by turbine number; the later-time step runs on one summary row per time. What remains lies
    after the last known value of the farm and takes that.
    """
    at = [*farm, "slot"]
    out = neighbours(df, cols, at, "turb_id", size, want=("next",))
    first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("turb_id"))) for c in cols}
    final = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turb_id"))) for c in cols}
    per_time = df.groupBy(*at).agg(
        *[f.alias(f"_f_{c}") for c, f in first.items()], *[f.alias(f"_l_{c}") for c, f in final.items()]
    )
    later = neighbours(per_time, [f"_f_{c}" for c in cols], farm, "slot", size, want=("next",))
    later = neighbours(later, [f"_l_{c}" for c in cols], farm, "slot", size, want=("prev",))
    later = later.select(
        *at,
        *[F.col(f"_next__f_{c}.value").alias(f"_later_{c}") for c in cols],
        *[F.col(f"_prev__l_{c}.value").alias(f"_earlier_{c}") for c in cols],
    )
    # a row's own time counts as "later" only for turbines behind it, so look from the next time on
    after = _strictly_later(later, cols, farm, size)
    out = out.join(after, at, "left")
    filled = {
        c: F.coalesce(c, f"_next_{c}.value", f"_after_{c}", f"_earlier_{c}") for c in cols
    }
    return out.withColumns(filled).drop(
        *[f"_next_{c}" for c in cols], *[f"_after_{c}" for c in cols], *[f"_earlier_{c}" for c in cols]
    )


def _strictly_later(later: DataFrame, cols: Sequence[str], farm: Sequence[str], size: int) -> DataFrame:
    """Move each time's "first known from here on" value to the time before it.

    Times are keys of the data, not necessarily gap-free, so the previous time is looked up with the same
    block-wise carry: the row after this one, in time order.
    """
    marked = later.withColumn("_here", F.struct(*[F.col(f"_later_{c}").alias(c) for c in cols]))
    keys = [*farm, "_blk"]
    base = marked.withColumn("_blk", block_id("slot", size))
    head = base.groupBy(*keys).agg(F.min_by("_here", "slot").alias("_head"))
    carried = head.select(*keys, F.lead("_head").over(Window.partitionBy(*farm).orderBy("_blk")).alias("_head"))
    inside = F.lead("_here").over(Window.partitionBy(*keys).orderBy("slot"))
    out = base.withColumn("_ahead", inside).join(carried, keys, "left")
    return out.select(
        *farm,
        "slot",
        *[F.coalesce(F.col(f"_ahead.{c}"), F.when(F.col("_ahead").isNull(), F.col(f"_head.{c}"))).alias(f"_after_{c}") for c in cols],
        *[f"_earlier_{c}" for c in cols],
    )


def future_calendar(df: DataFrame, steps: int, steps_per_day: int) -> DataFrame:
    """The next ``steps`` grid steps after the data, with the clock features known in advance."""
    from_slot = df.agg((F.max("slot") + 1).alias("_lo"))
    ahead = _with_slots(from_slot, F.col("_lo"), F.col("_lo") + steps - 1).drop("_lo")
    return with_clock(calendar(ahead, steps_per_day))
