"""Queries on scans, sinks, masks, joins, aggregates and scalar functions."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import functions as F

from aeolis.functions import scalar as sc
from aeolis.operators import farm, gaps
from aeolis.operators.blocks import step_index
from aeolis.operators.repair import temperature_percentiles
from aeolis.operators.rolling import roll_bundle
from aeolis.operators.split_scale import drop_warmup, scaler_fit
from aeolis.plans.fixture import ABNORMAL, ABNORMAL_EVAL, ALL, CURVE_F, STEPS_PER_DAY, UNKNOWN, H, W
from aeolis.plans.registry import query
from aeolis.session import shared_dir
from aeolis.sources import panel as src
from aeolis.sources.panel import MEASURES

KEY = ("turb_id", "slot")
NUM = " ".join(MEASURES)


# ---- scans and sinks


@query("scan_panel", f"SELECT turb_id, day, tmstamp, CAST(day AS VARCHAR) || ' ' || tmstamp AS date_key, {ALL} FROM panel", NUM)
def _(d):
    df = src.read_panel(d.spark, d.panel_path, "parquet")
    key = F.concat_ws(" ", F.col("date.day").cast("string"), "date.tmstamp")
    return df.select("turb_id", "day", "tmstamp", key.alias("date_key"), *MEASURES)


@query(
    "scan_recent_tail",
    f"""SELECT turb_id, slot, patv FROM (SELECT *, max(slot) OVER (PARTITION BY turb_id) AS m FROM panel) t
WHERE m - slot < {W + H}""",
    "patv",
)
def _(d):
    return src.recent_tail(d.panel.select(*KEY, "patv"), W + H)


@query("scan_partial_days", "SELECT turb_id, day, tmstamp, wspd, patv FROM panel WHERE day <= 14", "wspd patv")
def _(d):
    df = src.read_panel(d.spark, d.panel_path, "parquet", partial_days=14)
    return df.select("turb_id", "day", "tmstamp", "wspd", "patv")


def _as_file(d, rows, name):
    """A dimension as the CSV file that the readers expect."""
    path = os.path.join(shared_dir(d.spark), f"{name}-{uuid.uuid4().hex[:12]}")
    rows.write.csv(path, header=True)
    return path


@query("scan_dim_curve", "SELECT turb_id, a, beta, b, mx FROM curve", "a beta b mx")
def _(d):
    path = _as_file(d, d.curve.withColumnRenamed("turb_id", "TurbID").withColumn("cp", F.lit(0.4)), "curve")
    return src.read_curve(d.spark, path, d.turbines).drop("cp")


@query("scan_dim_angle", "SELECT turb_id, diff_angle FROM angle", "diff_angle")
def _(d):
    return src.read_angle(d.spark, _as_file(d, d.angle.withColumnRenamed("turb_id", "TurbID"), "angle"), d.turbines)


@query("sink_features", "SELECT turb_id, slot, patv, target, data_type FROM split WHERE data_type = 'valid'", "patv target")
def _(d):
    written = src.stage_features(d.split.select(*KEY, "patv", "target", "data_type"))
    return written.filter(F.col("data_type") == "valid")


@query(
    "sink_scaler",
    """SELECT turb_id, 'patv' AS feature, avg(patv) AS mean, stddev_samp(patv) AS std FROM split
WHERE data_type = 'train' GROUP BY turb_id""",
    "mean std",
    5,
)
def _(d):
    return src.stage_scaler(scaler_fit(d.split.filter("data_type = 'train'"), ["patv"]))


# ---- projections, filters, masks


@query("mask_abnormal_patv", f"SELECT turb_id, slot, {ABNORMAL} AS abnormal_patv FROM full_panel")
def _(d):
    return d.full_panel.select(*KEY, sc.abnormal_patv().alias("abnormal_patv"))


@query("mask_abnormal_eval", f"SELECT turb_id, slot, {ABNORMAL_EVAL} AS abnormal FROM full_panel")
def _(d):
    return d.full_panel.select(*KEY, sc.abnormal_eval().alias("abnormal"))


@query("mask_unknown", f"""SELECT turb_id, slot, CASE WHEN {UNKNOWN} THEN 0 ELSE 1 END AS mask,
CASE WHEN {UNKNOWN} THEN NULL ELSE patv END AS patv FROM full_panel""", "patv")
def _(d):
    return sc.with_unknown_mask(d.full_panel).select(*KEY, "mask", "patv")


@query("mask_pitch", """SELECT turb_id, slot,
CASE WHEN pab1 > 89 OR pab2 > 89 OR pab3 > 89 THEN 0 ELSE 1 END AS pab_mask FROM full_panel""")
def _(d):
    return sc.with_unknown_mask(d.full_panel).select(*KEY, "pab_mask")


@query("mask_ndir", """SELECT turb_id, slot, coalesce(ndir < -720 OR ndir > 720, false) AS abnormal_ndir,
CASE WHEN ndir BETWEEN -720 AND 720 THEN ndir END AS ndir FROM full_panel""", "ndir")
def _(d):
    return sc.with_ndir_mask(d.full_panel).select(*KEY, "abnormal_ndir", "ndir")


@query("fill_zero", "SELECT turb_id, slot, coalesce(wspd, 0) AS wspd, coalesce(patv, 0) AS patv FROM full_panel", "wspd patv")
def _(d):
    return sc.fill_zero(d.full_panel.select(*KEY, "wspd", "patv"))


@query("clip_nonneg", """SELECT turb_id, slot, CASE WHEN prtv < 0 THEN 0 ELSE prtv END AS prtv,
CASE WHEN patv < 0 THEN 0 ELSE patv END AS patv FROM full_panel""", "prtv patv")
def _(d):
    return sc.clip_nonneg(d.full_panel).select(*KEY, "prtv", "patv")


@query("project_keep_cols", "SELECT turb_id, slot, day, hour, tmstamp, wspd, wdir, etmp, itmp, ndir, prtv, patv FROM panel",
       "wspd wdir etmp itmp ndir prtv patv")
def _(d):
    return sc.drop_prefixed(d.panel.withColumn("abnormal_patv", sc.abnormal_patv()))


@query("clean_names", "SELECT turb_id, slot, wspd AS patv__qh_10, patv AS win24_mean_patv FROM panel", "patv__qh_10 win24_mean_patv")
def _(d):
    return sc.clean_names(
        d.panel.select(*KEY, F.col("wspd").alias("patv__qh_1.0"), F.col("patv").alias("win24_<mean>_patv"))
    )


@query("filter_warmup", f"SELECT turb_id, time, patv FROM stepped WHERE time >= {W - 1}", "patv")
def _(d):
    return drop_warmup(d.stepped, W - 1).select("turb_id", "time", "patv")


@query("filter_split", "SELECT turb_id, slot, data_type FROM split WHERE data_type = 'pred'")
def _(d):
    return d.split.filter("data_type = 'pred'").select(*KEY, "data_type")


@query("clip_capacity", """SELECT turb_id, slot, CASE WHEN patv IS NULL THEN NULL
ELSE least(greatest(patv * 2, 0), 1521.6) END AS patv FROM full_panel""", "patv")
def _(d):
    return d.full_panel.select(*KEY, sc.clip_capacity(F.col("patv") * 2).alias("patv"))


@query("unit_scale", "SELECT turb_id, slot, patv / 1521.6e0 AS patv, prtv / 1000e0 AS prtv FROM panel", "patv prtv")
def _(d):
    return sc.unit_scale(sc.unit_scale(d.panel, ["patv"]), ["prtv"], 1000).select(*KEY, "patv", "prtv")


@query("downcast_float", "SELECT turb_id, slot, CAST(patv AS FLOAT) AS patv FROM panel", "patv", 3)
def _(d):
    return sc.downcast_float(d.panel.select(*KEY, "patv"), ["patv"])


# ---- joins


@query("join_farm_stats", """SELECT turb_id, slot, etmp, avg(etmp) OVER t AS etmp_mean, stddev_samp(etmp) OVER t AS etmp_std
FROM panel WINDOW t AS (PARTITION BY day, tmstamp)""", "etmp etmp_mean etmp_std", 5)
def _(d):
    stats = farm.farm_stats(d.panel, "etmp", "etmp").drop("etmp_median")
    return farm.join_time(d.panel, stats).select(*KEY, "etmp", "etmp_mean", "etmp_std")


@query("join_curve_left", f"SELECT turb_id, slot, {CURVE_F} AS max_patv FROM full_panel LEFT JOIN (SELECT * FROM curve WHERE turb_id <> 2) c USING (turb_id)",
       "max_patv", 5)
def _(d):
    return sc.with_curve(d.full_panel, d.curve.filter("turb_id <> 2")).select(*KEY, "max_patv")


@query("join_curve_inner", f"SELECT turb_id, slot, {CURVE_F} AS max_patv FROM full_panel JOIN (SELECT * FROM curve WHERE turb_id <> 2) c USING (turb_id)",
       "max_patv", 5)
def _(d):
    return sc.with_curve(d.full_panel, d.curve.filter("turb_id <> 2"), "inner").select(*KEY, "max_patv")


@query("join_angle_left", "SELECT turb_id, slot, ndir, diff_angle FROM panel LEFT JOIN angle USING (turb_id)", "ndir diff_angle")
def _(d):
    return sc.with_wind_angle(d.panel, d.angle).select(*KEY, "ndir", "diff_angle")


@query("cross_spine", "SELECT turb_id, slot FROM turbines, grid")
def _(d):
    return gaps.turbine_grid(d.panel)


@query("join_spine_left", "SELECT turb_id, slot, wspd, patv FROM full_panel", "wspd patv")
def _(d):
    return gaps.turbine_grid(d.panel).join(d.panel.select(*KEY, "wspd", "patv"), list(KEY), "left")


@query("join_feature_blocks", """SELECT turb_id, time, patv,
 CASE WHEN count(patv) OVER w = 24 THEN avg(patv) OVER w END AS win24_mean_patv,
 patv - CASE WHEN count(patv) OVER w = 24 THEN avg(patv) OVER w END AS seasonal_patv
FROM stepped WINDOW w AS (PARTITION BY turb_id ORDER BY time ROWS 23 PRECEDING)""", "patv win24_mean_patv seasonal_patv")
def _(d):
    rows = d.stepped.select("turb_id", "time", "patv")
    rolled = roll_bundle(rows, ["patv"], [H]).select("turb_id", "time", f"win{H}_mean_patv")
    seasonal = d.seasonal().select("turb_id", "time", "seasonal_patv")
    keys = ["turb_id", "time"]
    return rows.join(rolled, keys, "left").join(seasonal, keys, "left")


@query("join_medians", """SELECT turb_id, slot, patv, wspd_median, etmp_median FROM panel
LEFT JOIN (SELECT day, tmstamp, median(wspd) AS wspd_median, median(etmp) AS etmp_median FROM panel GROUP BY day, tmstamp) m
USING (day, tmstamp)""", "patv wspd_median etmp_median")
def _(d):
    medians = farm.farm_medians(d.panel, ["wspd", "etmp"])
    return farm.join_time(d.panel, medians).select(*KEY, "patv", "wspd_median", "etmp_median")


# ---- aggregates


@query("farm_etmp_moments", """SELECT day, tmstamp, avg(etmp) AS mean, stddev_samp(etmp) AS std, median(etmp) AS median,
avg(etmp) - 3 * stddev_samp(etmp) AS bottom_limit, avg(etmp) + 3 * stddev_samp(etmp) AS upper_limit
FROM panel GROUP BY day, tmstamp""", "mean std median bottom_limit upper_limit", 5)
def _(d):
    s = farm.farm_stats(d.panel, "etmp", "f")
    mean, std = F.col("f_mean"), F.col("f_std")
    return s.select("day", "tmstamp", mean.alias("mean"), std.alias("std"), F.col("f_median").alias("median"),
                    (mean - 3 * std).alias("bottom_limit"), (mean + 3 * std).alias("upper_limit"))


def _bfill_sql(col: str, p: str) -> str:
    cols = [f"{p}_mean", f"{p}_median", f"{p}_std"]
    ahead = ", ".join(
        f"first_value({c} IGNORE NULLS) OVER (ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
        for c in cols
    )
    return f"""SELECT slot, {ahead} FROM (SELECT slot, avg({col}) AS {cols[0]}, median({col}) AS {cols[1]},
stddev_samp({col}) AS {cols[2]} FROM full_panel GROUP BY slot) s"""


def _farm_filled(d, col, p):
    stats = farm.farm_stats(d.farmed, col, p, ("farm_id", "slot"))
    return farm.fill_along_time(stats, [f"{p}_mean", f"{p}_median", f"{p}_std"]).drop("farm_id")


@query("farm_temp_stats", _bfill_sql("etmp", "etmp"), "etmp_mean etmp_median etmp_std", 5)
def _(d):
    return _farm_filled(d, "etmp", "etmp")


@query("farm_wind_stats", _bfill_sql("wspd", "ws"), "ws_mean ws_median ws_std", 5)
def _(d):
    return _farm_filled(d, "wspd", "ws")


@query("farm_percentiles", """SELECT day, tmstamp,
median(etmp) AS etmp_median, quantile_cont(etmp, 0.85) AS etmp_ub, quantile_cont(etmp, 0.15) AS etmp_lb,
median(itmp) AS itmp_median, quantile_cont(itmp, 0.85) AS itmp_ub, quantile_cont(itmp, 0.15) AS itmp_lb
FROM panel WHERE etmp BETWEEN -20 AND 50 GROUP BY day, tmstamp""",
       "etmp_median etmp_ub etmp_lb itmp_median itmp_ub itmp_lb", 5)
def _(d):
    return temperature_percentiles(d.panel)


@query("farm_median_cols", """SELECT slot,
first_value(wspd IGNORE NULLS) OVER w AS wspd_median, first_value(etmp IGNORE NULLS) OVER w AS etmp_median
FROM (SELECT slot, median(wspd) AS wspd, median(etmp) AS etmp FROM full_panel GROUP BY slot) s
WINDOW w AS (ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "wspd_median etmp_median")
def _(d):
    medians = farm.farm_medians(d.farmed, ["wspd", "etmp"], ("farm_id", "slot"))
    return farm.fill_along_time(medians, ["wspd_median", "etmp_median"]).drop("farm_id")


@query("mask_share", "SELECT day, tmstamp, avg(mask) AS mask_mean FROM masked GROUP BY day, tmstamp", "mask_mean")
def _(d):
    return farm.mask_share(d.masked)


@query("normal_row_means", f"""SELECT day, tmstamp, avg(patv) FILTER (WHERE ok) AS patv_mean,
avg(etmp) FILTER (WHERE ok) AS etmp_mean, avg(wspd) FILTER (WHERE ok) AS wspd_mean
FROM (SELECT *, mask = 1 AND NOT coalesce(raw_patv > {CURVE_F}, false) AS ok FROM masked LEFT JOIN curve USING (turb_id)) m
GROUP BY day, tmstamp""", "patv_mean etmp_mean wspd_mean")
def _(d):
    above = sc.known(F.col("raw_patv") > F.col("max_patv"))
    rows = sc.with_curve(d.masked, d.curve).withColumn("mask2", above)
    return farm.normal_row_means(rows, {"patv_mean": "patv", "etmp_mean": "etmp", "wspd_mean": "wspd"})


@query("pivot_patv", """SELECT t.day, t.tmstamp, u.turb_id, p.patv FROM (SELECT DISTINCT day, tmstamp FROM panel) t
CROSS JOIN turbines u LEFT JOIN panel p ON p.day = t.day AND p.tmstamp = t.tmstamp AND p.turb_id = u.turb_id""", "patv")
def _(d):
    turbines = sorted(r["turb_id"] for r in d.curve.select("turb_id").collect())  # the columns of a model's input, from the dimension
    wide = farm.pivot_patv(d.panel, turbines)
    return farm.unpivot_patv(wide)


@query("distinct_keys", """SELECT count(DISTINCT turb_id) AS n_turbines, count(DISTINCT slot) AS n_times,
count(DISTINCT day) AS n_days FROM panel""")
def _(d):
    return d.panel.agg(
        F.count_distinct("turb_id").alias("n_turbines"),
        F.count_distinct("slot").alias("n_times"),
        F.count_distinct("day").alias("n_days"),
    )


def _scaler_sql(std: str) -> str:
    return " UNION ALL ".join(
        f"SELECT turb_id, '{f}' AS feature, avg({f}) AS mean, {std}({f}) AS std FROM split WHERE data_type = 'train' GROUP BY turb_id"
        for f in ("wspd", "etmp", "patv", "diff_angle")
    )


@query("scaler_fit", _scaler_sql("stddev_samp"), "mean std", 5)
def _(d):
    return scaler_fit(d.split.filter("data_type = 'train'"), ["wspd", "etmp", "patv", "diff_angle"])


@query("scaler_fit_pop", _scaler_sql("stddev_pop"), "mean std", 5)
def _(d):
    return scaler_fit(d.split.filter("data_type = 'train'"), ["wspd", "etmp", "patv", "diff_angle"], population=True)


@query("split_counts", "SELECT data_type, count(*) AS n FROM split GROUP BY data_type")
def _(d):
    return d.split.groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))


# ---- scalar functions


@query("wind_angle", "SELECT turb_id, time, w_angle, w_angle_adj FROM basis", "w_angle w_angle_adj")
def _(d):
    return d.basis.select("turb_id", "time", "w_angle", "w_angle_adj")


@query("angle_sincos", "SELECT turb_id, time, w_angle_sin, w_angle_cos FROM basis", "w_angle_sin w_angle_cos")
def _(d):
    return d.basis.select("turb_id", "time", "w_angle_sin", "w_angle_cos")


@query("minute_features", """SELECT turb_id, slot, hour * 60 AS min_of_day, hour * 60 + (day - 1) * 1440 AS minutes FROM panel""")
def _(d):
    return sc.with_clock(d.panel).select(*KEY, "min_of_day", "minutes")


TURN = f"{2 * math.pi!r} * hour * 60 / 1440"


@query("time_sincos", f"SELECT turb_id, slot, sin({TURN}) AS sin_tm, cos({TURN}) AS cos_tm FROM panel", "sin_tm cos_tm")
def _(d):
    return sc.with_clock(d.panel).select(*KEY, "sin_tm", "cos_tm")


@query("day_norm", "SELECT turb_id, slot, day / 200e0 AS day_norm FROM panel", "day_norm")
def _(d):
    return sc.with_clock(d.panel).select(*KEY, "day_norm")


@query("time_key_string", "SELECT turb_id, CAST(day AS VARCHAR) || ',' || tmstamp AS tm, day, tmstamp FROM panel")
def _(d):
    keyed = d.panel.select("turb_id", sc.time_key().alias("tm"))
    return sc.split_time_key(keyed)


@query("future_calendar", f"""SELECT slot, sin({2 * math.pi!r} * (slot % 24) * 60 / 1440) AS sin_tm,
cos({2 * math.pi!r} * (slot % 24) * 60 / 1440) AS cos_tm
FROM (SELECT unnest(range(m + 1, m + 1 + {H})) AS slot FROM (SELECT max(slot) AS m FROM panel) x) y""", "sin_tm cos_tm")
def _(d):
    return gaps.future_calendar(d.panel, H, STEPS_PER_DAY).select("slot", "sin_tm", "cos_tm")


# ---- set operations, order, limit


@query("union_repaired", f"""SELECT turb_id, slot, CASE WHEN {ABNORMAL} THEN 0 ELSE patv END AS patv, {ABNORMAL} AS repaired FROM panel""", "patv")
def _(d):
    rows = d.panel.withColumn("repaired", sc.abnormal_patv()).select(*KEY, "patv", "repaired")
    fixed = rows.filter("repaired").withColumn("patv", F.lit(0.0))
    return rows.filter("NOT repaired").unionByName(fixed)


@query("union_splits", "SELECT turb_id, slot, data_type FROM split WHERE data_type IN ('valid', 'test')")
def _(d):
    part = lambda t: d.split.filter(F.col("data_type") == t).select(*KEY, "data_type")
    return part("valid").unionByName(part("test"))


@query("sort_panel", "SELECT turb_id, day, tmstamp, patv FROM panel ORDER BY turb_id, day, tmstamp", "patv")
def _(d):
    return d.panel.select("turb_id", "day", "tmstamp", "patv").orderBy("turb_id", "day", "tmstamp")


@query("last_window", f"""SELECT turb_id, slot, patv FROM (SELECT *, max(slot) OVER (PARTITION BY turb_id) AS m FROM full_panel) t
WHERE m - slot < {W}""", "patv")
def _(d):
    return src.recent_tail(d.full_panel.select(*KEY, "patv"), W)


@query("time_grid", "SELECT slot, slot // 24 + 1 AS day, lpad(CAST(slot % 24 AS VARCHAR), 2, '0') || ':00' AS tmstamp FROM grid")
def _(d):
    return gaps.time_grid(d.panel, STEPS_PER_DAY)


@query("fill_missing_slots", f"SELECT turb_id, slot, day, tmstamp, {ALL} FROM full_panel", NUM)
def _(d):
    return gaps.fill_missing_slots(d.panel, STEPS_PER_DAY)


@query("step_index", "SELECT turb_id, slot, time FROM stepped")
def _(d):
    return step_index(d.panel.select("turb_id", "day", "slot")).select(*KEY, "time")
