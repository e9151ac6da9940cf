"""Splits by time, scaling with stored statistics, and sequence samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolis.operators.blocks import BLOCK, ENTITY, keep_own, shift, with_halo
from aeolis.operators.rolling import trailing


def with_label(df: DataFrame, horizon: int, pos: str = "time", entity: Sequence[str] = ENTITY) -> DataFrame:
    """Target = power ``horizon`` rows later; the scoring mask moves along with it."""
    moved = {"target": ("patv", horizon)}
    if "abnormal" in df.columns:
        moved["abnormal"] = ("abnormal", horizon)
    return shift(df, moved, entity, pos)


def drop_warmup(df: DataFrame, first: int, pos: str = "time") -> DataFrame:
    return df.filter(F.col(pos) >= first)


def drop_horizon_tail(df: DataFrame, horizon: int, pos: str = "time", entity: Sequence[str] = ENTITY) -> DataFrame:
    """Drop the last ``horizon`` rows of each entity, whose target is still unknown."""
    last = df.groupBy(*entity).agg(F.max(pos).alias("_last"))
    return df.join(last, list(entity)).filter(F.col(pos) <= F.col("_last") - horizon).drop("_last")


def _nth_last_day(df: DataFrame, n: int) -> Column:
    """The n-th newest distinct day, as a one-row subquery (a top-n sort, never a full one)."""
    newest = df.select("day").distinct().orderBy(F.desc("day")).limit(n)
    return newest.agg(F.min("day")).scalar()


def split_by_day(
    df: DataFrame, valid_days: int, test_days: int, online: bool = False, calendar: DataFrame | None = None
) -> DataFrame:
    """Rows without a target are ``pred``; else the last days are ``test``, those before ``valid``.

    Two extra days at the end are reserved for the forecast itself. ``calendar`` is any cheaper table with the
    same days (the source of ``df``), to spare a second evaluation of ``df``.
    """
    days = df if calendar is None else calendar
    kind = F.when(F.col("target").isNull(), "pred")
    if not online:
        test_from = _nth_last_day(days, test_days + 2)
        valid_from = _nth_last_day(days, valid_days + test_days + 2)
        kind = kind.when(F.col("day") >= test_from, "test").when(F.col("day") >= valid_from, "valid")
    return df.withColumn("data_type", kind.otherwise("train"))


def split_by_steps(
    df: DataFrame, input_len: int, valid_steps: int, test_steps: int, mode: str = "val", pos: str = "slot"
) -> DataFrame:
    """Step ranges of the short-horizon leg. Valid and test start ``input_len`` earlier, to have a history, so a row
    may appear under two labels."""
    total = df.agg(F.max(pos) + 1).scalar()
    step = F.col(pos)
    if mode == "train":
        ranges = {"train": (0, valid_steps), "val": (valid_steps + input_len, 0)}
    elif mode == "val":
        both = valid_steps + test_steps
        ranges = {"train": (0, both), "val": (both + input_len, test_steps), "test": (test_steps + input_len, 0)}
    elif mode == "test":
        ranges = {"test": (test_steps + input_len, 0)}
    elif mode == "finetune":
        ranges = {"finetune": (0, 0)}
    elif mode == "submit":
        ranges = {"submit": (input_len, 0)}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    labels = []
    for label, (start, stop) in ranges.items():
        lower = step >= (total - start) if start else F.lit(True)
        labels.append(F.when(lower & (step < total - stop), F.lit(label)))
    return df.withColumn("split", F.explode(F.array_compact(F.array(*labels))))


def _long(df: DataFrame, keys: Sequence[str], feats: Sequence[str]) -> DataFrame:
    rows = F.explode(
        F.array(
            *[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std")) for f in feats]
        )
    )
    return df.select(*keys, rows.alias("r")).select(*keys, "r.feature", "r.mean", "r.std")


def scaler_fit(df: DataFrame, feats: Sequence[str], entity: Sequence[str] = ENTITY, population: bool = False) -> DataFrame:
    """Long table (entity, feature, mean, std) of the given (training) rows."""
    std = F.stddev_pop if population else F.stddev_samp
    stats = [a for f in feats for a in (F.avg(f).alias(f"m_{f}"), std(f).alias(f"s_{f}"))]
    return _long(df.groupBy(*entity).agg(*stats), entity, feats)


def _wide(scaler: DataFrame, feats: Sequence[str], entity: Sequence[str]) -> DataFrame:
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    return scaler.groupBy(*entity).agg(
        *[a for f in feats for a in (pick(f, "mean").alias(f"m_{f}"), pick(f, "std").alias(f"s_{f}"))]
    )


def _attach(df: DataFrame, scaler: DataFrame, feats: Sequence[str], entity: Sequence[str]) -> DataFrame:
    wide = _wide(scaler, feats, entity)
    if entity:
        return df.join(wide, list(entity), "left")
    one = wide.select(F.struct("*").alias("s")).scalar()
    return df.withColumn("_s", one).select("*", "_s.*").drop("_s")


def standardize(df: DataFrame, scaler: DataFrame, feats: Sequence[str], entity: Sequence[str] = ENTITY) -> DataFrame:
    """(x - mean) / std with a fitted or stored scaler; a constant feature becomes NULL."""
    out = _attach(df, scaler, feats, entity)
    scaled = {f: F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"s_{f}")) for f in feats}
    return out.withColumns(scaled).drop(*[f"{k}_{f}" for f in feats for k in "ms"])


def inverse_standardize(
    df: DataFrame, scaler: DataFrame, feats: Mapping[str, str], entity: Sequence[str] = ENTITY
) -> DataFrame:
    """x * std + mean; ``{column: feature whose scale it has}``, e.g. a prediction in the scale of the target."""
    names = sorted(set(feats.values()))
    out = _attach(df, scaler, names, entity)
    back = {c: F.col(c) * F.col(f"s_{f}") + F.col(f"m_{f}") for c, f in feats.items()}
    return out.withColumns(back).drop(*[f"{k}_{f}" for f in names for k in "ms"])


def scalable(cols: Sequence[str]) -> list[str]:
    """Bounded columns are left as they are."""
    return [c for c in cols if not any(tag in c for tag in ("sin", "cos", "mask_mean"))]


def sequence_samples(
    df: DataFrame,
    input_len: int,
    output_len: int,
    enc_cols: Sequence[str],
    dec_cols: Sequence[str],
    entity: Sequence[str] = ENTITY,
    pos: str = "slot",
    size: int = BLOCK,
) -> DataFrame:
    """Sliding samples, stride 1: arrays ``enc_<col>`` of the inputs and ``dec_<col>`` of the steps that follow.

    ``pos`` must be gap-free; missing values stay in place as NULL elements. ``anchor`` is the last input step.
    With ``output_len`` 0 there is no decoder part, as for a forecast.
    """
    haloed = with_halo(df, pos, size, back=input_len - 1, ahead=output_len)
    w = Window.partitionBy(*entity, "_blk").orderBy(pos)
    past, future = w.rowsBetween(1 - input_len, 0), w.rowsBetween(1, output_len)
    boxes = {"_enc": F.collect_list(F.struct(*enc_cols)).over(past)}
    enough = F.col("_own") & (F.size("_enc") == input_len)
    if output_len:
        boxes["_dec"] = F.collect_list(F.struct(*dec_cols)).over(future)
        enough = enough & (F.size("_dec") == output_len)
    else:
        dec_cols = ()
    out = haloed.withColumns(boxes).filter(enough)
    arrays = {f"enc_{c}": F.col(f"_enc.{c}") for c in enc_cols} | {f"dec_{c}": F.col(f"_dec.{c}") for c in dec_cols}
    return out.select(*entity, F.col(pos).alias("anchor"), *[c.alias(n) for n, c in arrays.items()])


def adaptive_norm(
    values: DataFrame, edges: DataFrame, input_len: int, col: str = "patv", farm: str = "farm_id"
) -> DataFrame:
    """Per sample (ending at ``slot``) and node: mean and std used to normalise it.

    All turbines share the pooled statistics of the window; a group's mean is that of its turbines summed, its std
    is that of its own series. Per-time moments come first, so the windows run over one row per time (and group).
    """
    scale = F.col(col) / 1000.0
    per_time = values.groupBy(farm, "slot").agg(
        F.count(scale).cast("double").alias("_n"),
        F.coalesce(F.sum(scale), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum(scale * scale), F.lit(0.0)).alias("_q"),
    )
    pooled = trailing(
        per_time,
        {"n": ("sum", "_n"), "s": ("sum", "_s"), "q": ("sum", "_q")},
        input_len,
        (farm,),
        "slot",
    ).filter(F.col("n") > 0)
    mean = F.col("s") / F.col("n")
    pooled = pooled.select(
        farm,
        "slot",
        (mean * 1000).alias("base_mean"),
        (F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))) * 1000).alias("base_std"),
    )
    groups = (
        values.join(edges, "turb_id")
        .groupBy(farm, "group_id", "slot")
        .agg(F.coalesce(F.sum(col), F.lit(0.0)).alias("_y"))
    )
    spread = trailing(groups, {"std": ("var_pop", "_y")}, input_len, (farm, "group_id"), "slot").select(
        farm, "slot", "group_id", F.sqrt("std").alias("std")
    )
    sizes = edges.groupBy("group_id").agg(F.count(F.lit(1)).alias("_k"))
    upper = (
        spread.filter("std IS NOT NULL")
        .join(sizes, "group_id")
        .join(pooled, [farm, "slot"])
        .select(farm, "slot", F.col("group_id").alias("node"), (F.col("_k") * F.col("base_mean")).alias("mean"), "std")
    )
    base = pooled.select(
        farm, "slot", F.lit("base").alias("node"), F.col("base_mean").alias("mean"), F.col("base_std").alias("std")
    )
    return base.unionByName(upper)
