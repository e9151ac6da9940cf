"""Statistics over all turbines at one time, and their way back to the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolis.operators.blocks import neighbours

TIME = ("day", "tmstamp")
#: Distinct values of a group that are ranked in one piece; ranges that a larger group is cut into.
FEW, RANGES = 65_536, 512


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    extra: Mapping[str, Column] | None = None,
    few: int = FEW,
) -> DataFrame:
    """Exact linear percentiles ``{out: (col, p)}`` per group, plus mergeable aggregates ``extra``. One plan for groups of any size.

    Equal values are counted before they are shuffled. Each group's own count says into how many ranges of values it is cut:
    none up to ``few`` distinct values, else the quantiles of a mergeable sketch. Sums over the ranges tell which one holds a wanted
    rank, and only there values are ranked, so that no task sorts a whole large group. Groups whose values are all NULL
    have NULL percentiles; NULL keys are a group.
    """
    keys, cols = list(keys), sorted({c for c, _ in wanted.values()})
    cells = [F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]
    long = df.select(F.struct(*keys).alias("_k"), F.explode(F.array(*cells)).alias("_e"))
    long = long.select("_k", F.col("_e.c").alias("_c"), F.col("_e.v").alias("_v")).where("_v IS NOT NULL")
    values = long.groupBy("_k", "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    marks = [i / RANGES for i in range(1, RANGES)]
    sizes = values.groupBy("_k", "_c").agg(
        F.sum("_n").alias("_total"),
        F.when(F.count(F.lit(1)) > few, F.array_distinct(F.percentile_approx("_v", marks, 10 * RANGES))).alias("_cuts"),
    )
    placed = values.join(sizes, ["_k", "_c"]).withColumn(
        "_b", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))
    )
    ranges = placed.groupBy("_k", "_c", "_b").agg(F.sum("_n").alias("_size"), F.max("_total").alias("_total"))
    before = F.sum("_size").over(Window.partitionBy("_k", "_c").orderBy("_b")) - F.col("_size")
    targets = ranges.withColumn("_before", before).withColumn("_q", F.explode(_ranks(wanted, cols))).where(
        (F.col("_q.c") == F.col("_c"))
        & (F.col("_q.rank") >= F.col("_before"))
        & (F.col("_q.rank") < F.col("_before") + F.col("_size"))
    )
    targets = targets.select("_k", "_c", "_b", "_before", "_q")
    inside = Window.partitionBy("_k", "_c", "_b").orderBy("_v")
    ranked = placed.drop("_cuts", "_total").join(targets.select("_k", "_c", "_b").distinct(), ["_k", "_c", "_b"], "left_semi")
    ranked = ranked.withColumn("_upto", F.sum("_n").over(inside))
    place = F.col("_q.rank") - F.col("_before")
    found = ranked.join(targets, ["_k", "_c", "_b"]).where((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")))
    pick = lambda o, side: F.max(F.when((F.col("_q.out") == o) & (F.col("_q.side") == side), F.col("_v")))
    share = lambda o: F.max(F.when(F.col("_q.out") == o, F.col("_q.share")))
    got = found.groupBy("_k").agg(
        *[(pick(o, "lo") + share(o) * (pick(o, "hi") - pick(o, "lo"))).alias(o) for o in wanted]
    )
    # Groups that have no known value come from the other side; both meet by one more aggregation, which NULL keys survive.
    others = df.groupBy(*keys).agg(F.lit(1).alias("_one"), *[c.alias(o) for o, c in (extra or {}).items()])
    both = others.select(F.struct(*keys).alias("_k"), *(extra or {})).unionByName(got, allowMissingColumns=True)
    out = both.groupBy("_k").agg(*[F.any_value(c, True).alias(c) for c in [*(extra or {}), *wanted]])
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], *(extra or {}), *wanted)


def _ranks(wanted: Mapping[str, tuple[str, float]], cols: Sequence[str]) -> Column:
    """The ranks on either side of each percentile, and the share of the way from one to the other."""
    out = []
    for o, (c, p) in wanted.items():
        h = (F.col("_total") - 1) * p
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            fields = {"c": F.lit(cols.index(c)), "out": F.lit(o), "side": F.lit(side), "rank": rank, "share": h - F.floor(h)}
            out.append(F.struct(*[v.alias(n) for n, v in fields.items()]))
    return F.array(*out)


def farm_stats(df: DataFrame, col: str, prefix: str, keys: Sequence[str] = TIME) -> DataFrame:
    """Mean, standard deviation (n-1) and median of ``col`` over the turbines of each time."""
    return group_percentiles(
        df,
        keys,
        {f"{prefix}_median": (col, 0.5)},
        {f"{prefix}_mean": F.avg(col), f"{prefix}_std": F.stddev_samp(col)},
    )


def farm_medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = TIME) -> DataFrame:
    return group_percentiles(df, keys, {f"{c}_median": (c, 0.5) for c in cols})


def fill_along_time(
    stats: DataFrame, cols: Sequence[str], pos: str = "slot", farm: Sequence[str] = ("farm_id",), forward: bool = False
) -> DataFrame:
    """Backward fill (then forward, if asked) of one-row-per-time series, separately per farm."""
    want = ("prev", "next") if forward else ("next",)
    out = neighbours(stats, cols, farm, pos, want=want)
    filled = {
        c: F.coalesce(c, f"_next_{c}.value", *([f"_prev_{c}.value"] if forward else [])) for c in cols
    }
    return out.withColumns(filled).drop(*[f"_{s}_{c}" for s in want for c in cols])


def join_time(df: DataFrame, stats: DataFrame, keys: Sequence[str] = TIME) -> DataFrame:
    """Statistics back to the rows: equi-join, so a wide time is split by the adaptive skew join."""
    return df.join(stats, list(keys), "left")


def mask_share(df: DataFrame, keys: Sequence[str] = TIME, mask: str = "mask") -> DataFrame:
    """Mean of the masks at each time (the mean alone, without any other column mixed in)."""
    return df.groupBy(*keys).agg(F.avg(mask).alias("mask_mean"))


def normal_row_means(df: DataFrame, cols: Mapping[str, str], keys: Sequence[str] = TIME) -> DataFrame:
    """Per-time means over rows that are usable and not above the power curve."""
    good = (F.col("mask") == 1) & ~F.col("mask2")
    return df.groupBy(*keys).agg(*[F.avg(F.when(good, F.col(c))).alias(o) for o, c in cols.items()])


def pivot_patv(df: DataFrame, turbines: Sequence[int], col: str = "patv", keys: Sequence[str] = TIME) -> DataFrame:
    """Time x turbine matrix, for model edges only; the column list is the caller's."""
    return df.groupBy(*keys).pivot("turb_id", list(turbines)).agg(F.avg(col)).withColumnsRenamed(
        {str(t): f"t{t}" for t in turbines}
    )


def unpivot_patv(df: DataFrame, keys: Sequence[str] = TIME, col: str = "patv") -> DataFrame:
    wide = [c for c in df.columns if c not in keys]
    return df.unpivot(list(keys), wide, "name", col).withColumn(
        "turb_id", F.substring_index("name", "t", -1).cast("bigint")
    ).drop("name")
