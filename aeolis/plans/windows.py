"""Queries on repairs, gaps, rolling windows and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeolis.functions import scalar as sc
from aeolis.operators import blend, gaps, repair
from aeolis.operators.rolling import roll_bundle, seasonal_residual, trailing, trailing_arrow
from aeolis.operators.split_scale import drop_horizon_tail
from aeolis.plans.fixture import ABNORMAL_EVAL, BUCKET, CURVE_F, LOOKBACK, H
from aeolis.plans.registry import query
from aeolis.settings import ROLL_FEATURES

KEY = ("turb_id", "slot")
DRAW = "(turb_id * 7919 + slot * 104729)"


# ---- anomaly repair


@query("repair_etmp_3sigma", """SELECT turb_id, slot, coalesce(abs(etmp - m) > 1.2 * s, false) AS abnormal_etmp,
CASE WHEN abs(etmp - m) > 1.2 * s THEN med ELSE etmp END AS etmp
FROM (SELECT *, avg(etmp) OVER t AS m, stddev_samp(etmp) OVER t AS s, median(etmp) OVER t AS med
      FROM full_panel WINDOW t AS (PARTITION BY day, tmstamp)) x""", "etmp", 5)
def _(d):
    # five turbines never reach three deviations (the bound is (n-1)/sqrt(n) = 1.79), hence 1.2 here
    return repair.repair_sigma(d.full_panel, "etmp", sigmas=1.2).select(*KEY, "abnormal_etmp", "etmp")


@query("repair_temp_percentile", """SELECT turb_id, slot, etmp AS origin_etmp, itmp AS origin_itmp,
CASE WHEN etmp > eu OR etmp < el THEN em ELSE etmp END AS etmp,
CASE WHEN itmp > iu OR itmp < il THEN im ELSE itmp END AS itmp, em AS etmp_median, im AS itmp_median
FROM full_panel LEFT JOIN (SELECT day, tmstamp, median(etmp) AS em, quantile_cont(etmp, 0.85) AS eu,
  quantile_cont(etmp, 0.15) AS el, median(itmp) AS im, quantile_cont(itmp, 0.85) AS iu, quantile_cont(itmp, 0.15) AS il
  FROM panel WHERE etmp BETWEEN -20 AND 50 GROUP BY day, tmstamp) s USING (day, tmstamp)""",
       "origin_etmp origin_itmp etmp itmp etmp_median itmp_median", 5)
def _(d):
    return repair.repair_temperature(d.full_panel).select(
        *KEY, "origin_etmp", "origin_itmp", "etmp", "itmp", "etmp_median", "itmp_median"
    )


@query("envelope_power", f"SELECT turb_id, slot, {CURVE_F} AS max_patv FROM full_panel LEFT JOIN curve USING (turb_id)", "max_patv", 5)
def _(d):
    return sc.with_curve(d.full_panel, d.curve).select(*KEY, "max_patv")


@query("envelope_residual", "SELECT turb_id, time, patv_residual FROM basis", "patv_residual", 5)
def _(d):
    return d.basis.select("turb_id", "time", "patv_residual")


@query("envelope_clip", f"""SELECT turb_id, slot, coalesce(patv > f, false) AS mask2, patv AS origin_patv,
CASE WHEN patv > f THEN f ELSE patv END AS patv
FROM (SELECT *, {CURVE_F} AS f FROM full_panel JOIN curve USING (turb_id)) x""", "origin_patv patv", 5)
def _(d):
    return sc.clip_to_curve(sc.with_curve(d.full_panel, d.curve, "inner")).select(*KEY, "mask2", "origin_patv", "patv")


@query("resample_noisy", f"""SELECT m.turb_id, m.slot, m.mask, CASE WHEN m.mask = 0 THEN p.patv ELSE m.patv END AS patv
FROM (SELECT x.*, n.size, CASE WHEN mask = 0 THEN {DRAW} % n.size END AS draw
      FROM (SELECT *, {BUCKET} AS ws_bucket FROM masked) x
      LEFT JOIN (SELECT ws_bucket, count(*) AS size FROM pool GROUP BY ws_bucket) n USING (ws_bucket)) m
LEFT JOIN pool p ON p.ws_bucket = m.ws_bucket AND p.rn = m.draw""", "patv")
def _(d):
    drawn = repair.resample_noisy(d.masked, repair.normal_pool(d.masked), draw=F.expr(DRAW))
    return drawn.select(*KEY, "mask", "patv")


@query("ws_bucket", f"SELECT {BUCKET} AS ws_bucket, count(*) AS n FROM panel GROUP BY 1", "ws_bucket", 2)
def _(d):
    return d.panel.groupBy(sc.wind_bucket(F.col("wspd")).alias("ws_bucket")).agg(F.count(F.lit(1)).alias("n"))


# ---- gaps

NEAR = """last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER p AS pp,
first_value(v IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER n AS np
FROM (SELECT turb_id, slot, CASE WHEN ndir BETWEEN -720 AND 720 THEN ndir END AS v FROM full_panel) x
WINDOW p AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       n AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("interp_linear", f"""SELECT turb_id, slot, CASE WHEN v IS NOT NULL THEN v
ELSE pv + (slot - pp) * (nv - pv) / (np - pp) END AS ndir FROM (SELECT turb_id, slot, v, {NEAR}) y
WHERE v IS NOT NULL OR (pv IS NOT NULL AND nv IS NOT NULL)""", "ndir")
def _(d):
    rows = sc.with_ndir_mask(d.full_panel).select(*KEY, "ndir")
    inner = gaps.interpolate(rows, "ndir", pos="slot", size=200, edges=False)
    return inner.filter("ndir IS NOT NULL")


@query("interp_edges", f"""SELECT turb_id, slot, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
ELSE pv + (slot - pp) * (nv - pv) / (np - pp) END AS ndir FROM (SELECT turb_id, slot, v, {NEAR}) y""", "ndir")
def _(d):
    return gaps.interpolate(sc.with_ndir_mask(d.full_panel).select(*KEY, "ndir"), "ndir", pos="slot", size=200)


@query("fill_row_order", """SELECT turb_id, slot,
coalesce(first_value(wspd IGNORE NULLS) OVER n, last_value(wspd IGNORE NULLS) OVER p) AS wspd,
coalesce(first_value(etmp IGNORE NULLS) OVER n, last_value(etmp IGNORE NULLS) OVER p) AS etmp FROM full_panel
WINDOW p AS (ORDER BY slot, turb_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       n AS (ORDER BY slot, turb_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "wspd etmp")
def _(d):
    return gaps.fill_row_order(d.farmed.select("farm_id", *KEY, "wspd", "etmp"), ["wspd", "etmp"]).drop("farm_id")


@query("fill_time_order", """SELECT turb_id, slot,
coalesce(first_value(patv IGNORE NULLS) OVER n, last_value(patv IGNORE NULLS) OVER p) AS patv FROM masked
WINDOW p AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       n AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "patv")
def _(d):
    return gaps.fill_time_order(d.masked.select(*KEY, "patv"), ["patv"])


# ---- trailing windows (NULL cells included: the window must be full)


def _roll_sql(agg: str, out: str) -> str:
    return f"""SELECT turb_id, slot, CASE WHEN count(patv) OVER w = {H} THEN {agg} OVER w END AS {out} FROM full_panel
WINDOW w AS (PARTITION BY turb_id ORDER BY slot ROWS {H - 1} PRECEDING)"""


def _rolled(stat: str, out: str):
    def build(d):
        return trailing(d.full_panel.select(*KEY, "patv"), {out: (stat, "patv")}, H, pos="slot").drop("patv")

    return build


query("roll_mean", _roll_sql("avg(patv)", "roll_mean"), "roll_mean")(_rolled("mean", "roll_mean"))
query("roll_max", _roll_sql("max(patv)", "roll_max"), "roll_max")(_rolled("max", "roll_max"))
query("roll_min", _roll_sql("min(patv)", "roll_min"), "roll_min")(_rolled("min", "roll_min"))
query("roll_var", _roll_sql("var_samp(patv)", "roll_var"), "roll_var", 5)(_rolled("var", "roll_var"))
query("roll_skew", _roll_sql("skewness(patv)", "roll_skew"), "roll_skew", 7)(_rolled("skew", "roll_skew"))
query("roll_kurt", _roll_sql("kurtosis(patv)", "roll_kurt"), "roll_kurt", 7)(_rolled("kurt", "roll_kurt"))
query("roll_share", _roll_sql("avg(patv)", "roll_share"), "roll_share")(_rolled("share", "roll_share"))


@query("roll_median", _roll_sql("median(patv)", "roll_median"), "roll_median")
def _(d):
    rows = d.full_panel.select(*KEY, "patv")
    return trailing_arrow(rows, {"roll_median": ("median", "patv", H)}, pos="slot").drop("patv")


def _bundle_sql() -> str:
    fns = {"mean": "avg", "amax": "max", "amin": "min", "var": "var_samp", "median": "median"}
    cols = ", ".join(
        f"CASE WHEN count({f}) OVER w = {H} THEN {fn}({f}) OVER w END AS win{H}_{n}_{f}"
        for f in ROLL_FEATURES
        for n, fn in fns.items()
    )
    return f"SELECT turb_id, time, {cols} FROM basis WINDOW w AS (PARTITION BY turb_id ORDER BY time ROWS {H - 1} PRECEDING)"


BUNDLE = [f"win{H}_{n}_{f}" for f in ROLL_FEATURES for n in ("mean", "amax", "amin", "var", "median")]


@query("roll_bundle", _bundle_sql(), " ".join(BUNDLE), 5)
def _(d):
    return roll_bundle(d.basis.select("turb_id", "time", *ROLL_FEATURES), ROLL_FEATURES, [H]).drop(*ROLL_FEATURES)


@query("seasonal_residual", f"""SELECT turb_id, time,
patv - CASE WHEN count(patv) OVER w = {H} THEN avg(patv) OVER w END AS seasonal_patv FROM stepped
WINDOW w AS (PARTITION BY turb_id ORDER BY time ROWS {H - 1} PRECEDING)""", "seasonal_patv")
def _(d):
    return seasonal_residual(d.stepped.select("turb_id", "time", "patv"), H).drop("patv")


@query("label_lead", f"SELECT turb_id, time, lead(patv, {H}) OVER (PARTITION BY turb_id ORDER BY time) AS target FROM stepped", "target")
def _(d):
    return d.labelled.select("turb_id", "time", "target")


@query("mask_lead", f"SELECT turb_id, time, lead({ABNORMAL_EVAL}, {H}) OVER (PARTITION BY turb_id ORDER BY time) AS abnormal FROM stepped")
def _(d):
    return d.labelled.select("turb_id", "time", "abnormal")


@query("drop_horizon_tail", f"""SELECT turb_id, time, patv FROM (SELECT *, max(time) OVER (PARTITION BY turb_id) AS m FROM stepped) t
WHERE time <= m - {H}""", "patv")
def _(d):
    return drop_horizon_tail(d.stepped.select("turb_id", "time", "patv"), H)


@query("last_k_median", f"""SELECT turb_id, median(patv) AS last FROM full_panel WHERE slot >= (SELECT min(slot) FROM
(SELECT DISTINCT slot FROM full_panel WHERE patv IS NOT NULL ORDER BY slot DESC LIMIT {LOOKBACK}) x) GROUP BY turb_id""", "last")
def _(d):
    return blend.last_k_median(d.history, LOOKBACK)


@query("lookback_means", f"""SELECT turb_id, pos // {H} AS block, mt AS mean_true, mp AS mean_pred, sh AS abnormal_share
FROM (SELECT turb_id, time AS pos,
  avg(CASE WHEN NOT abnormal THEN y END) OVER w AS mt, avg(CASE WHEN NOT abnormal THEN yhat END) OVER w AS mp,
  sum(CASE WHEN abnormal THEN 1.0 ELSE 0.0 END) OVER w / {LOOKBACK} AS sh FROM evaluated
  WINDOW w AS (PARTITION BY turb_id ORDER BY time ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)) z
WHERE pos % {H} = 0 AND pos > 0""", "mean_true mean_pred abnormal_share")
def _(d):
    rows = d.evaluated.withColumnsRenamed({"yhat": "pred_target", "y": "target"})
    stats = blend.lookback_means(rows, H, LOOKBACK)
    # a block of its own must exist behind the look-back rows
    last = d.evaluated.groupBy("turb_id").agg(F.floor(F.max("time") / H).alias("_b"))
    return stats.join(last, "turb_id").filter("block <= _b").drop("_b")
