"""Exact ordered windows over series of any length, cut into blocks of bounded size.

A plain ``Window.partitionBy(entity)`` puts a whole entity into one task. One entity may hold a third of a
table, so every ordered operator here works on (entity, block) pairs instead. Two exact devices are used:

* bounded frames (lags, leads, trailing windows): each block also receives the few rows of its neighbours that
  its frames reach, the *halo*; halo rows are dropped afterwards;
* unbounded frames (row numbers, last known value): work inside the block, plus one summary row per block that is
  carried along the entity and joined back on the key the big side is already partitioned by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per block of a windowed operator, and of one that only carries a summary row from block to block.
BLOCK = 4096
CARRY_BLOCK = 65536
ENTITY = ("turb_id",)


def step_index(
    df: DataFrame,
    entity: Sequence[str] = ENTITY,
    slot: str = "slot",
    out: str = "time",
    size: int = CARRY_BLOCK,
) -> DataFrame:
    """Position 0..n-1 of each row inside its entity, in slot order (slots may have gaps).

    Rows are numbered inside (entity, block of slots); the block sizes, one row per block, give the offset.
    """
    keys = [*entity, "_blk"]
    placed = df.withColumn("_blk", block_id(slot, size))
    earlier = Window.partitionBy(*entity).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    )
    numbered = placed.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(slot)))
    return (
        numbered.join(offsets, keys)
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
        .drop("_off", "_rn", "_blk")
    )


def block_id(pos: str | Column, size: int) -> Column:
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(col / F.lit(size)).cast("bigint")


def with_halo(df: DataFrame, pos: str, size: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Copy each row to every block whose frames reach it; ``_own`` marks the row in its home block."""
    home = block_id(pos, size)
    first = block_id(F.greatest(F.col(pos) - F.lit(ahead), F.lit(0)), size)
    last = block_id(F.col(pos) + F.lit(back), size)
    return df.withColumn("_blk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_blk") == home)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle on ``keys`` into the session's full number of partitions.

    Adaptive execution sizes partitions by bytes and would put a few narrow columns into one or two tasks; work that
    is heavy per row needs all of them. A grouping on the same keys that follows reuses this shuffle.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys)


def keep_own(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_blk")


def over_rows(
    df: DataFrame,
    build,
    back: int = 0,
    ahead: int = 0,
    entity: Sequence[str] = ENTITY,
    pos: str = "time",
    size: int = BLOCK,
) -> DataFrame:
    """Add the columns ``build(window)`` whose row frames stay within ``back`` rows before and ``ahead`` after.

    ``pos`` must be a gap-free row position (:func:`step_index` or a completed grid).
    """
    haloed = with_halo(df, pos, size, back, ahead)
    window = Window.partitionBy(*entity, "_blk").orderBy(pos)
    return keep_own(haloed.withColumns(build(window)))


def shift(
    df: DataFrame,
    cols: Mapping[str, tuple[str, int]],
    entity: Sequence[str] = ENTITY,
    pos: str = "time",
    size: int = BLOCK,
) -> DataFrame:
    """``{out: (col, k)}``: value of ``col`` k rows later (negative: earlier)."""
    ahead = max([k for _, k in cols.values()] + [0])
    back = max([-k for _, k in cols.values()] + [0])
    return over_rows(
        df,
        lambda w: {o: F.lead(c, k).over(w) if k >= 0 else F.lag(c, -k).over(w) for o, (c, k) in cols.items()},
        back=back,
        ahead=ahead,
        entity=entity,
        pos=pos,
        size=size,
    )


def from_end(
    df: DataFrame,
    entity: Sequence[str] = ENTITY,
    pos: str = "slot",
    out: str = "_from_end",
) -> DataFrame:
    """Distance of each row to the last position of its entity (0 = newest).

    The per-entity maximum is a map-side-combined aggregate with one row per entity, joined back.
    """
    last = df.groupBy(*entity).agg(F.max(pos).alias("_last"))
    return df.join(last, list(entity)).withColumn(out, F.col("_last") - F.col(pos)).drop("_last")


def neighbours(
    df: DataFrame,
    cols: Sequence[str],
    entity: Sequence[str] = ENTITY,
    pos: str = "time",
    size: int = CARRY_BLOCK,
    want: Sequence[str] = ("prev", "next"),
) -> DataFrame:
    """For each column add ``_prev_<col>`` / ``_next_<col>``: struct(pos, value) of the nearest known value,
    the row itself included."""
    keys = [*entity, "_blk"]
    base = df.withColumn("_blk", block_id(pos, size))
    at = {c: F.when(F.col(c).isNotNull(), F.col(pos)) for c in cols}
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("pos"), F.col(c).alias("value"))) for c in cols}
    # position and value are aggregated apart: a struct would force a sort of the big side instead of a hash map
    edge = {"prev": (F.max, F.max_by), "next": (F.min, F.min_by)}
    parts = [
        a.alias(f"_{s}0{kind}_{c}")
        for s in want
        for c in cols
        for kind, a in (("p", edge[s][0](at[c])), ("v", edge[s][1](c, at[c])))
    ]
    summary = base.groupBy(*keys).agg(*parts)
    box = lambda s, c: F.struct(F.col(f"_{s}0p_{c}").alias("pos"), F.col(f"_{s}0v_{c}").alias("value"))
    summary = summary.select(
        *keys,
        *[F.when(F.col(f"_{s}0p_{c}").isNotNull(), box(s, c)).alias(f"_{s}0_{c}") for s in want for c in cols],
    )
    along = {
        "prev": Window.partitionBy(*entity).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1),
        "next": Window.partitionBy(*entity).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1),
    }
    carried = summary.select(
        *keys,
        *[F.last(f"_{s}0_{c}", ignorenulls=True).over(along[s]).alias(f"_{s}1_{c}") for s in want for c in cols],
    )
    inside = {
        "prev": Window.partitionBy(*keys).orderBy(pos),
        "next": Window.partitionBy(*keys).orderBy(F.desc(pos)),
    }
    out = base
    for s in want:
        frame = inside[s].rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumns({f"_{s}_{c}": F.last(known[c], ignorenulls=True).over(frame) for c in cols})
    out = out.join(carried, keys, "left")
    return out.withColumns(
        {f"_{s}_{c}": F.coalesce(f"_{s}_{c}", f"_{s}1_{c}") for s in want for c in cols}
    ).drop("_blk", *[f"_{s}1_{c}" for s in want for c in cols])
