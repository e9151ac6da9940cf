"""The two forecasting legs and their combination, from the raw panel to (turb_id, step, yhat).

Intermediate results that several later steps read are written to the shared folder (:func:`aeolis.session.stage`):
lost executors then cost a re-read, and every reader prunes the columns it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolis.functions import scalar as sc
from aeolis.operators import blend, farm, gaps, hierarchy, metrics, models, repair, split_scale
from aeolis.operators import segments as segments_
from aeolis.operators.blocks import from_end, neighbours, step_index
from aeolis.operators.boosting import Booster
from aeolis.operators.feature_blocks import long_leg_blocks
from aeolis.session import stage
from aeolis.settings import ROLL_FEATURES, SEGMENTS, PanelSettings
from aeolis.sources.panel import MEASURES

KEYS = ["turb_id", "time"]


@dataclass(frozen=True)
class Boosting:
    """Size of the tree models."""

    rounds: int = 500
    rate: float = 0.03
    leaves: int = 31
    members: tuple = tuple((m["seed"], m["share"]) for m in models.ensemble_grid())


# ---- long-horizon leg


def with_absent_slots(rows: DataFrame, steps_per_day: int) -> DataFrame:
    """Every slot from a turbine's first reading to the farm's last slot; ``absent`` marks those without a reading.

    Their measures lie on the line between the readings around them and stay at the turbine's last one behind it.
    """
    grid = gaps.fill_missing_slots(rows.withColumn("absent", F.lit(False)), steps_per_day)
    begins = rows.groupBy("turb_id").agg(F.min("slot").alias("_begin"))
    grid = grid.join(begins, "turb_id").filter("slot >= _begin").drop("_begin")
    grid = stage(grid.withColumn("absent", F.col("absent").isNull()), "complete")
    near = neighbours(grid, MEASURES, pos="slot")

    def line(c):
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (F.col("slot") - prev["pos"]) / (nxt["pos"] - prev["pos"])
        between = F.coalesce(prev["value"] + share * (nxt["value"] - prev["value"]), prev["value"])
        return F.when(F.col("absent"), between).otherwise(F.col(c))

    return near.withColumns({c: line(c) for c in MEASURES}).drop(*[f"_{s}_{c}" for s in ("prev", "next") for c in MEASURES])


def repaired_panel(
    panel: DataFrame,
    boosting: Boosting,
    steps_per_day: int,
    repair_model: Booster | None = None,
    repair_nodes: DataFrame | None = None,
) -> DataFrame:
    """Temperature, direction and power repaired, missing slots completed; the scoring mask kept as ``abnormal``.

    A slot without a reading counts as abnormal: it takes no part in scores, and its power is repaired like any other.
    Power is repaired by ``repair_nodes`` (a stored ensemble's node table), by ``repair_model``, or by a model fitted here.
    """
    rows = with_absent_slots(sc.fill_zero(repair.repair_sigma(panel, "etmp")), steps_per_day)
    # both masks look at the readings as delivered, before any direction is interpolated
    masks = {"abnormal": sc.abnormal_eval() | F.col("absent"), "abnormal_patv": sc.abnormal_patv() | F.col("absent")}
    rows = stage(rows.withColumns(masks).drop("absent"), "masked")
    cols = list(models.REPAIR_INPUTS)
    smooth = gaps.interpolate(sc.with_ndir_mask(step_index(rows)), "ndir")
    smooth = stage(smooth, "smooth")
    if repair_model is None and repair_nodes is None:
        repair_model = models.train_boosted_trees(
            smooth.filter("NOT abnormal_patv"), cols, label="patv", rounds=boosting.rounds, rate=boosting.rate, leaves=boosting.leaves
        )
    if repair_nodes is not None:
        scored = models.predict_stored(smooth, repair_nodes)
    else:
        scored = models.predict(repair_model, smooth, "prediction")
    fixed = repair.overwrite_abnormal(scored, flag=F.col("abnormal_patv"))
    return sc.drop_prefixed(sc.clip_nonneg(fixed))


def long_leg_features(
    panel: DataFrame,
    curve: DataFrame,
    angle: DataFrame,
    settings: PanelSettings,
    boosting: Boosting,
    online: bool = False,
    repair_model: Booster | None = None,
    repair_nodes: DataFrame | None = None,
) -> DataFrame:
    """All features, target and split of the long-horizon leg, not yet scaled."""
    base = repaired_panel(panel, boosting, settings.steps_per_day, repair_model, repair_nodes)
    base = stage(sc.with_wind_angle(sc.with_residual(sc.with_curve(base, curve)), angle), "basis")
    # rows without a full series window are the warm-up
    kept = long_leg_blocks(base, ROLL_FEATURES, settings.roll, settings.series, settings.horizon)
    return split_scale.split_by_day(stage(kept, "features"), settings.valid_days, settings.test_days, online)


@dataclass
class LongLeg:
    """Fitted state of the long-horizon leg."""

    features: list[str]
    scaler: DataFrame
    members: list[Booster]


def fit_long_leg(features: DataFrame, boosting: Boosting) -> LongLeg:
    cols = models.feature_columns(features)
    real = [c for c in cols if c != "turb_id"]
    train = features.filter("data_type = 'train'")
    scaler = stage(split_scale.scaler_fit(train, [*real, "target"]), "scaler")
    scaled = split_scale.standardize(features, scaler, [*real, "target"])
    ready = stage(
        scaled.filter("data_type IN ('train', 'valid')").withColumn("is_valid", F.col("data_type") == "valid"), "scaled"
    ).filter("target IS NOT NULL")
    members = [
        models.train_boosted_trees(
            ready,
            cols,
            validation="is_valid",
            rounds=boosting.rounds,
            rate=boosting.rate,
            share=share,
            leaves=boosting.leaves,
            seed=seed,
        )
        for seed, share in boosting.members
    ]
    return LongLeg(cols, scaler, members)


def score_long_leg(leg: LongLeg, features: DataFrame) -> DataFrame:
    """Mean prediction of the members for every row, in power units; the target stays unscaled."""
    real = [c for c in leg.features if c != "turb_id"]
    keep = ["turb_id", "time", "slot", "day", "abnormal", "data_type"]
    scaled = split_scale.standardize(features.withColumn("_y", F.col("target")), leg.scaler, real)
    out = models.predict_mean(leg.members, scaled).select(*keep, F.col("_y").alias("target"), "pred_target")
    return split_scale.inverse_standardize(out, leg.scaler, {"pred_target": "target"})


def evaluate_long_leg(leg: LongLeg, features: DataFrame, settings: PanelSettings) -> DataFrame:
    """Sliding score of the held-out splits, after the short-term correction."""
    held = score_long_leg(leg, features.filter("data_type IN ('valid', 'test')"))
    held = stage(step_index(held, out="pos"), "held-out")
    fixed = blend.residual_decay_adjust(held, settings.horizon, settings.lookback, pos="pos")
    scores = None
    for part in ("valid", "test"):
        # the last horizon of a split has targets from beyond it
        kept = split_scale.drop_horizon_tail(fixed.filter(F.col("data_type") == part), settings.horizon)
        rows = kept.select("turb_id", "slot", F.col("target").alias("y"), F.col("pred_target").alias("yhat"), "abnormal")
        one = metrics.score_sliding(step_index(rows), settings.horizon).withColumn("data_type", F.lit(part))
        scores = one if scores is None else scores.unionByName(one)
    return scores


def forecast_long_leg(leg: LongLeg, features: DataFrame, settings: PanelSettings) -> DataFrame:
    """(turb_id, step, yhat): the rows still without a target predict the coming horizon.

    Steps count from the farm's last slot, as in the short leg. The features reach up to it for every turbine, so all with a
    full series window have all steps.
    """
    last = features.agg(F.max("slot").alias("last")).scalar()
    back = last - F.col("slot")
    newest = features.withColumn("_back", back).filter(F.col("_back") < settings.horizon)
    step = (settings.horizon - 1 - F.col("_back")).cast("bigint")
    steps = newest.select(*KEYS, step.alias("step"))
    scored = score_long_leg(leg, newest.drop("_back")).join(steps, KEYS)
    return blend.add_jitter(scored.select("turb_id", "step", F.col("pred_target").alias("yhat")))


# ---- short-horizon leg


def short_leg_rows(panel: DataFrame, curve: DataFrame, angle: DataFrame, settings: PanelSettings) -> DataFrame:
    """Complete grid of repaired rows: power above the curve clipped, unusable power re-drawn, gaps filled."""
    rows = sc.clip_to_curve(sc.with_curve(panel, curve, "inner"))
    rows = gaps.fill_missing_slots(rows, settings.steps_per_day).withColumn("farm_id", F.lit(1))
    rows = stage(sc.with_wind_angle(rows, angle), "grid")
    rows = gaps.fill_row_order(rows, ["w_angle_sin", "w_angle_cos", "wspd"])
    rows = repair.repair_temperature(stage(sc.with_unknown_mask(rows), "filled"))
    kept = ["farm_id", "turb_id", "slot", "day", "tmstamp", "wspd", "etmp", "itmp", "patv"]
    rows = stage(rows.select(*kept, "w_angle_sin", "w_angle_cos", "mask", "pab_mask", "etmp_median", "itmp_median"), "clean")
    drawn = repair.resample_noisy(rows, repair.normal_pool(rows)).drop("ws_bucket")
    return stage(gaps.fill_time_order(drawn, ["patv"]), "short-rows")


def farm_series(rows: DataFrame) -> DataFrame:
    """One row per time: farm temperature and wind, share of usable rows, direction medians, clock."""
    at = ("farm_id", "slot", "day", "tmstamp")
    cols = {"etmp": "etmp", "wspd": "ws"}
    wanted = {f"{p}_median": (c, 0.5) for c, p in cols.items()}
    wanted |= {f"{c}_median": (c, 0.5) for c in ("w_angle_sin", "w_angle_cos")}
    extra = {f"{p}_{n}": f(c) for c, p in cols.items() for n, f in (("mean", F.avg), ("std", F.stddev_samp))}
    stats = farm.group_percentiles(rows, at, wanted, extra | {"mask_mean": F.avg("mask")})
    filled = farm.fill_along_time(stats, [*wanted, *extra], forward=True)
    return sc.with_clock(filled)


def short_leg_values(rows: DataFrame, edges: DataFrame, settings: PanelSettings) -> DataFrame:
    """(node, slot, patv, mask) of turbines and groups, power divided by capacity."""
    power = hierarchy.rollup(rows, edges)
    masks = hierarchy.rollup_mask(rows, edges)
    return sc.unit_scale(power.join(masks, ["node", "slot"]), ["patv"], settings.capacity)


def forecast_short_leg(
    panel: DataFrame,
    rows: DataFrame,
    settings: PanelSettings,
    input_len: int,
    segments: Sequence[tuple[int, int]] = SEGMENTS,
    fade: int = 60,
) -> DataFrame:
    """(turb_id, step, yhat): median over the configurations of each segment, joined along the horizon, pulled to
    the last known power, kept within capacity."""
    # The farm's temperature, wind and usable share at the anchor are inputs next to the turbine's own window.
    farmwide = ("etmp_median", "ws_median", "farm_mask")
    stats = farm_series(rows).select("slot", "etmp_median", "ws_median", F.col("mask_mean").alias("farm_mask"))
    narrow = stage(rows.select("turb_id", "slot", "patv", "wspd").join(stats, "slot"), "short-inputs")
    other = (*segments_.CLOCK_INPUTS, *farmwide)
    samples = segments_.segment_samples(narrow, (input_len,), segments, settings.steps_per_day, farmwide)
    fitted = segments_.train_segment_models(samples, segments, input_len, other=other)
    recent = from_end(narrow).filter(F.col("_from_end") < input_len).drop("_from_end")
    newest = segments_.segment_samples(recent, (input_len,), (), settings.steps_per_day, farmwide)
    scored = segments_.score_segment_models(newest, fitted, ("turb_id", "anchor"))
    steps = scored.withColumn("step", F.explode(F.sequence("seg_start", F.col("seg_end") - 1)))
    merged = steps.groupBy("turb_id", "step").agg(F.median("yhat").alias("yhat"))
    clipped = merged.withColumn("yhat", sc.clip_capacity(F.col("yhat"), settings.capacity))
    return blend.anchor_adjust(clipped, panel.select("turb_id", "slot", "patv"), fade, settings.lookback)


# ---- both


def combined_forecast(short: DataFrame, long: DataFrame, settings: PanelSettings) -> DataFrame:
    return blend.blend_legs(short, long, settings.blend_start)
