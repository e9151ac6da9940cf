"""Queries on splits, scaling, samples, hierarchy, models, blending and metrics."""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from aeolis.functions import scalar as sc
from aeolis.operators import blend, farm, hierarchy, metrics, models, repair, sample_scale, segments, split_scale
from aeolis.plans.fixture import ABNORMAL, CURVE_F, FADE, LOOKBACK, STEPS, TEST_DAYS, VALID_DAYS, H
from aeolis.plans.registry import query
from aeolis.session import shared_dir, stage
from aeolis.sources import panel as src

KEY = ("turb_id", "slot")
STEP = ("turb_id", "step")
FEATS = ["wspd", "etmp", "patv", "diff_angle"]
IN, OUT = 48, 24


# ---- splits, scaling


@query("split_by_day", "SELECT turb_id, slot, data_type FROM split")
def _(d):
    return d.split.select(*KEY, "data_type")


@query("split_by_steps", f"""SELECT turb_id, slot, r.label AS split FROM panel, (SELECT max(slot) + 1 AS n FROM panel) t,
(VALUES ('train', 0, {10 * 24}), ('val', {10 * 24 + IN}, {5 * 24}), ('test', {5 * 24 + IN}, 0)) r(label, back, cut)
WHERE slot < n - cut AND (back = 0 OR slot >= n - back)""")
def _(d):
    rows = d.panel.select(*KEY)
    return split_scale.split_by_steps(rows, IN, VALID_DAYS * 24, TEST_DAYS * 24)


TRAIN = "split WHERE data_type = 'train'"
SCALED = ", ".join(f"(s.{f} - m_{f}) / nullif(s_{f}, 0) AS {f}" for f in FEATS)
STATS = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FEATS)
SCALED_SQL = f"""SELECT s.turb_id, slot, {SCALED} FROM split s
JOIN (SELECT turb_id, {STATS} FROM {TRAIN} GROUP BY turb_id) t ON t.turb_id = s.turb_id"""


def _scaler(d):
    return split_scale.scaler_fit(d.split.filter("data_type = 'train'"), FEATS)


@query("standardize", SCALED_SQL, " ".join(FEATS))
def _(d):
    return split_scale.standardize(d.split, _scaler(d), FEATS).select(*KEY, *FEATS)


@query("standardize_saved", SCALED_SQL, " ".join(FEATS))
def _(d):
    return split_scale.standardize(d.split, src.stage_scaler(_scaler(d)), FEATS).select(*KEY, *FEATS)


@query("inverse_standardize", """SELECT s.turb_id, slot, patv, 0.5 * sd + mu AS pred_target FROM split s
JOIN (SELECT turb_id, avg(target) AS mu, stddev_samp(target) AS sd FROM split WHERE data_type = 'train' GROUP BY turb_id) t
ON t.turb_id = s.turb_id""", "patv pred_target")
def _(d):
    scaler = stage(
        split_scale.scaler_fit(d.split.filter("data_type = 'train'"), ["patv", "target"]), "scaler"
    )
    scaled = split_scale.standardize(d.split, scaler, ["patv"]).withColumn("pred_target", F.lit(0.5))
    back = split_scale.inverse_standardize(scaled, scaler, {"patv": "patv", "pred_target": "target"})
    return back.select(*KEY, "patv", "pred_target")


@query("scale_columns", """SELECT slot, (ws_median - avg(ws_median) OVER ()) / stddev_pop(ws_median) OVER () AS ws_median,
(etmp_median - avg(etmp_median) OVER ()) / stddev_pop(etmp_median) OVER () AS etmp_median, mask_mean
FROM (SELECT slot, median(wspd) AS ws_median, median(etmp) AS etmp_median, avg(mask) AS mask_mean FROM masked GROUP BY slot
      HAVING count(wspd) > 0) s""", "ws_median etmp_median mask_mean")
def _(d):
    cols = ["ws_median", "etmp_median", "mask_mean"]
    series = farm.group_percentiles(
        d.masked, ["slot"], {"ws_median": ("wspd", 0.5), "etmp_median": ("etmp", 0.5)}, {"mask_mean": F.avg("mask")}
    ).filter("ws_median IS NOT NULL")
    chosen = split_scale.scalable(cols)
    return split_scale.standardize(series, split_scale.scaler_fit(series, chosen, (), population=True), chosen, ())


ADAPTIVE_SQL = f"""WITH t AS (SELECT slot, count(patv) AS n, sum(patv) AS s, sum(patv * patv) AS q FROM masked GROUP BY slot),
b AS (SELECT slot, sum(s) OVER w / sum(n) OVER w AS m, sqrt(sum(q) OVER w / sum(n) OVER w - pow(sum(s) OVER w / sum(n) OVER w, 2)) AS sd,
  count(*) OVER w AS k, sum(n) OVER w AS n FROM t WINDOW w AS (ORDER BY slot ROWS {IN - 1} PRECEDING)),
g AS (SELECT group_id, slot, coalesce(sum(patv), 0) AS y FROM masked JOIN hier USING (turb_id) GROUP BY group_id, slot),
u AS (SELECT group_id, slot, stddev_pop(y) OVER (PARTITION BY group_id ORDER BY slot ROWS {IN - 1} PRECEDING) AS sd FROM g)
SELECT slot, 'base' AS node, m AS mean, sd AS std FROM b WHERE k = {IN} AND n > 0
UNION ALL SELECT b.slot, u.group_id, c.k * b.m, u.sd FROM b JOIN u ON u.slot = b.slot
JOIN (SELECT group_id, count(*) AS k FROM hier GROUP BY group_id) c ON c.group_id = u.group_id WHERE b.k = {IN} AND b.n > 0"""


def _farmed_power(d):
    return d.masked.withColumn("farm_id", F.lit(1)).select("farm_id", *KEY, "patv")


@query("adaptive_norm", ADAPTIVE_SQL, "mean std", 4)
def _(d):
    return split_scale.adaptive_norm(_farmed_power(d), d.hier, IN).drop("farm_id")


def _scaled_sql(key, series, norm):
    """Sums of the scaled samples' inputs and outputs, and sums weighted by the distance from the anchor."""
    z = "(v.x - n.mean) / nullif(n.std, 0)"
    return f"""SELECT {", ".join("v." + k for k in key)}, n.slot AS anchor, v.slot > n.slot AS future, sum({z}) AS total,
sum({z} * (v.slot - n.slot)) AS moment, count({z}) AS known FROM ({series}) v JOIN ({norm}) n
ON v.norm_key = n.node AND v.slot BETWEEN n.slot - {IN - 1} AND n.slot + {OUT}
WHERE n.slot + {OUT} <= (SELECT max(slot) FROM panel) GROUP BY ALL"""


def _sample_sums(scaled, key):
    return scaled.groupBy(*key, "anchor", (F.col("offset") > 0).alias("future")).agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("offset")).alias("moment"), F.count("value").alias("known")
    )


@query("scaled_samples", _scaled_sql(["node"], """SELECT 't' || CAST(turb_id AS VARCHAR) AS node, 'base' AS norm_key, slot, patv AS x FROM masked
UNION ALL SELECT group_id, group_id, slot, coalesce(sum(patv), 0) FROM masked JOIN hier USING (turb_id) GROUP BY group_id, slot""", ADAPTIVE_SQL), "total moment", 4)
def _(d):
    """Power of turbines and groups, each sample by its own normaliser."""
    power = _farmed_power(d)
    base = power.select(hierarchy.node_of_turbine().alias("node"), "slot", F.col("patv").alias("value"))
    # as in the normaliser, a step at which no turbine of a group is known counts as zero
    groups = hierarchy.rollup(power.fillna(0.0, ["patv"]), d.hier).withColumnRenamed("patv", "value")
    series = base.unionByName(groups.join(d.hier.select(F.col("group_id").alias("node")).distinct(), "node", "left_semi"))
    norm = sample_scale.node_norm(power, d.hier, IN)
    return _sample_sums(sample_scale.scale_samples(series, norm, IN, OUT, ["node"]), ["node"])


LONG_SQL = " UNION ALL ".join(f"SELECT turb_id, '{c}' AS feature, slot, {c} AS x FROM masked" for c in ("wspd", "etmp"))


@query("scaled_columns", _scaled_sql(["turb_id", "feature"], f"SELECT *, feature || CAST(turb_id AS VARCHAR) AS norm_key FROM ({LONG_SQL}) l",
f"""SELECT slot, node, mean, std FROM (SELECT slot, feature || CAST(turb_id AS VARCHAR) AS node, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS std, count(*) OVER w AS k
FROM ({LONG_SQL}) l WINDOW w AS (PARTITION BY turb_id, feature ORDER BY slot ROWS {IN - 1} PRECEDING)) s WHERE k = {IN}"""), "total moment", 4)
def _(d):
    """Columns beside power, each sample by the statistics of its own inputs."""
    cols, key = split_scale.scalable(["wspd", "etmp", "w_angle_sin"]), ["turb_id", "feature"]
    rows = d.masked.select(*KEY, *cols)
    series = rows.unpivot(list(KEY), cols, "feature", "value")
    return _sample_sums(sample_scale.scale_samples(series, sample_scale.column_norm(rows, cols, IN), IN, OUT, key), key)


SAMPLE_SUMS = f"""sum(patv) OVER p AS enc_sum, count(patv) OVER p AS enc_known, sum(patv) OVER n AS dec_sum,
count(patv) OVER n AS dec_known, first_value(patv) OVER p AS enc_first, last_value(patv) OVER n AS dec_last,
count(*) OVER p AS np, count(*) OVER n AS nn FROM masked
WINDOW p AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN {IN - 1} PRECEDING AND CURRENT ROW),
       n AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND {OUT} FOLLOWING)"""


def _total(array):
    return F.aggregate(F.filter(array, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)


def _samples(d):
    rows = d.masked.select(*KEY, "patv", "wspd", (F.col("slot") % 24).cast("double").alias("hour"))
    return split_scale.sequence_samples(rows, IN, OUT, ["patv", "wspd"], ["patv", "hour"])


@query("sequence_samples", f"""SELECT turb_id, slot AS anchor, coalesce(enc_sum, 0) AS enc_sum, enc_known, coalesce(dec_sum, 0) AS dec_sum,
dec_known, enc_first, dec_last FROM (SELECT turb_id, slot, {SAMPLE_SUMS}) s WHERE np = {IN} AND nn = {OUT}""",
       "enc_sum dec_sum enc_first dec_last", 4)
def _(d):
    known = lambda c: F.size(F.filter(c, lambda v: v.isNotNull())).cast("bigint")
    return _samples(d).select(
        "turb_id", "anchor",
        _total(F.col("enc_patv")).alias("enc_sum"), known(F.col("enc_patv")).alias("enc_known"),
        _total(F.col("dec_patv")).alias("dec_sum"), known(F.col("dec_patv")).alias("dec_known"),
        F.col("enc_patv")[0].alias("enc_first"), F.col("dec_patv")[OUT - 1].alias("dec_last"),
    )


@query("sequence_columns", f"""SELECT turb_id, slot AS anchor, coalesce(enc_wspd, 0) AS enc_wspd_sum, dec_hour AS dec_hour_sum
FROM (SELECT turb_id, slot, sum(wspd) OVER p AS enc_wspd, sum(slot % 24) OVER n AS dec_hour, count(*) OVER p AS np,
count(*) OVER n AS nn FROM masked
WINDOW p AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN {IN - 1} PRECEDING AND CURRENT ROW),
       n AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND {OUT} FOLLOWING)) s WHERE np = {IN} AND nn = {OUT}""",
       "enc_wspd_sum dec_hour_sum", 4)
def _(d):
    return _samples(d).select(
        "turb_id", "anchor", _total(F.col("enc_wspd")).alias("enc_wspd_sum"), _total(F.col("dec_hour")).alias("dec_hour_sum")
    )


# ---- hierarchy


@query("hierarchy_rollup", """SELECT 't' || CAST(turb_id AS VARCHAR) AS node, slot, patv FROM panel
UNION ALL SELECT group_id, slot, sum(patv) FROM panel JOIN hier USING (turb_id) GROUP BY group_id, slot""", "patv")
def _(d):
    return hierarchy.rollup(d.panel, d.hier)


@query("hierarchy_mask", """SELECT 't' || CAST(turb_id AS VARCHAR) AS node, slot, mask FROM masked
UNION ALL SELECT group_id, slot, min(mask) FROM masked JOIN hier USING (turb_id) GROUP BY group_id, slot""")
def _(d):
    return hierarchy.rollup_mask(d.masked, d.hier)


@query("hierarchy_matrix", """SELECT group_id AS "row", 't' || CAST(turb_id AS VARCHAR) AS col, -1.0 AS "value" FROM hier
UNION ALL SELECT DISTINCT group_id, group_id, 1.0 FROM hier""", "value")
def _(d):
    return hierarchy.constraint_matrix(d.hier)


NODES = """SELECT 't' || CAST(turb_id AS VARCHAR) AS node, slot, patv AS yhat FROM full_panel WHERE patv IS NOT NULL
UNION ALL SELECT group_id, slot, sum(patv) + 10 * (slot % 7) FROM full_panel JOIN hier USING (turb_id)
WHERE patv IS NOT NULL GROUP BY group_id, slot"""


def _incoherent(d, edges):
    """Turbine values, and group values that are off by a known amount."""
    rows = d.panel.select(*KEY, F.col("patv").alias("yhat"))
    off = F.when(F.col("node").startswith("t") & (F.col("node") != "total"), 0.0).otherwise(10.0 * (F.col("slot") % 7))
    return hierarchy.rollup(rows, edges, "yhat").withColumn("yhat", F.col("yhat") + off)


@query("coherence_residual", "SELECT group_id, slot, 10.0 * (slot % 7) AS residual FROM (SELECT DISTINCT group_id, slot FROM panel JOIN hier USING (turb_id)) g",
       "residual", 4)
def _(d):
    return hierarchy.coherence_residual(_incoherent(d, d.hier), d.hier, step="slot")


@query("hierarchy_reconcile", """WITH e AS (SELECT slot, 10.0 * (slot % 7) / ((SELECT count(*) FROM turbines) + 1) AS share FROM (SELECT DISTINCT slot FROM panel) x)
SELECT 't' || CAST(turb_id AS VARCHAR) AS node, slot, patv + share AS yhat FROM panel JOIN e USING (slot)
UNION ALL SELECT 'total', slot, sum(patv) + 10 * (slot % 7) - any_value(share) FROM panel JOIN e USING (slot) GROUP BY slot""", "yhat", 4)
def _(d):
    total = d.hier.filter("group_id = 'total'")
    # The statement divides by all turbines, also at slots where some have no reading.
    return hierarchy.reconcile(_incoherent(d, total), total, step="slot", absent_as_zero=True)


@query("reconcile_residual", "SELECT DISTINCT group_id, slot, 0e0 AS residual FROM panel JOIN hier USING (turb_id)", "residual", 4)
def _(d):
    """All overlapping groups: reconciled forecasts add up."""
    fixed = hierarchy.reconcile(_incoherent(d, d.hier), d.hier, step="slot")
    return hierarchy.coherence_residual(fixed, d.hier, step="slot")


@query("reconcile_overlapping")
def _(d):
    return hierarchy.reconcile(_incoherent(d, d.hier), d.hier, step="slot")


# ---- training and scoring

# Two models of two trees each (fixed node table).
TREE_ROWS = [
    (1, 0, 0, "wspd", 7.5, True, 1, 2, None), (1, 0, 1, "etmp", 10.0, False, 3, 4, None),
    (1, 0, 2, "patv", 700.0, True, 5, 6, None), (1, 0, 3, None, None, None, None, None, 100.0),
    (1, 0, 4, None, None, None, None, None, 150.0), (1, 0, 5, None, None, None, None, None, 400.0),
    (1, 0, 6, None, None, None, None, None, 900.0), (1, 1, 0, "patv", 300.0, False, 1, 2, None),
    (1, 1, 1, None, None, None, None, None, -20.0), (1, 1, 2, None, None, None, None, None, 30.0),
    (2, 0, 0, "patv", 500.0, True, 1, 2, None), (2, 0, 1, None, None, None, None, None, 210.0),
    (2, 0, 2, "wspd", 5.0, True, 3, 4, None), (2, 0, 3, None, None, None, None, None, 610.0),
    (2, 0, 4, None, None, None, None, None, 820.0), (2, 1, 0, "etmp", 5.0, True, 1, 2, None),
    (2, 1, 1, None, None, None, None, None, 12.5), (2, 1, 2, None, None, None, None, None, -7.25),
]
TREE_SCHEMA = (
    "model_id bigint, tree_id bigint, node_id bigint, feature string, threshold double, default_left boolean, "
    "left_id bigint, right_id bigint, leaf_value double"
)


def _tree_sql(model: int) -> str:
    by = {(m, t, n): r for r in TREE_ROWS for m, t, n in [r[:3]]}

    def walk(tree: int, node: int) -> str:
        _, _, _, f, cut, left, lid, rid, leaf = by[(model, tree, node)]
        if lid is None:
            return repr(leaf)
        return f"CASE WHEN coalesce({f} <= {cut}, {str(left).lower()}) THEN {walk(tree, lid)} ELSE {walk(tree, rid)} END"

    trees = sorted({t for m, t, _ in by if m == model})
    return " + ".join(f"({walk(t, 0)})" for t in trees)


@query("score_tree_table", " UNION ALL ".join(
    f"SELECT turb_id, slot, CAST({m} AS BIGINT) AS model_id, {_tree_sql(m)} AS score FROM full_panel" for m in (1, 2)), "score")
def _(d):
    nodes = d.spark.createDataFrame(TREE_ROWS, TREE_SCHEMA)
    return models.score_tree_table(d.full_panel, nodes, KEY)


@query("score_mean_ensemble", "SELECT turb_id, step, avg(yhat) AS yhat FROM preds GROUP BY turb_id, step", "yhat")
def _(d):
    return models.mean_ensemble(d.preds)


@query("train_grid", """SELECT grid, CAST(days AS BIGINT) AS days, CAST(hidden1 AS BIGINT) AS hidden1, CAST(hidden2 AS BIGINT) AS hidden2,
CAST(output_len AS BIGINT) AS output_len, CAST(partial_days AS BIGINT) AS partial_days, attention, CAST(days * 24 AS BIGINT) AS input_len,
greatest((SELECT count(DISTINCT slot) FROM panel WHERE partial_days IS NULL OR day <= partial_days) - days * 24 - output_len + 1, 0) AS samples
FROM (SELECT 'main' AS grid, unnest([64, 128]) AS hidden1, [12, 36, 72, 144, 288] AS outs
      UNION ALL SELECT 'temperature', 64, [108, 216]) g,
 (SELECT unnest([2, 4, 7]) AS days) a, (SELECT unnest([8, 16]) AS hidden2) b, (SELECT unnest([NULL, 14]) AS partial_days) c,
 (SELECT unnest([true, false]) AS attention) e, LATERAL (SELECT unnest(g.outs) AS output_len) o""")
def _(d):
    # 140 of 245 days become 14 of 30
    grids = {
        "main": models.GRID_MAIN | {"partial_days": (None, 14)},
        "temperature": models.GRID_TEMPERATURE | {"partial_days": (None, 14)},
    }
    grid = models.grid_rows(d.spark, grids, 24)
    return models.grid_sample_counts(grid, d.panel, (None, 14))


@query("masked_loss", """SELECT model_id, avg(pow((y - yhat) * mask, 2)) AS loss,
0.82e0 * avg(pow((y - yhat) * mask, 2)) + 0.18e0 * avg(pow(y - yhat, 2)) AS two_part FROM scored GROUP BY model_id""", "loss two_part", 4)
def _(d):
    both = metrics.two_part_loss(metrics.masked_loss(), metrics.mse(), epoch=1)
    return d.scored.groupBy("model_id").agg(metrics.masked_loss().alias("loss"), both.alias("two_part"))


def _training_rows(d):
    return stage(d.split.join(d.panel.select(*KEY, "wdir", "itmp", "ndir", "prtv"), list(KEY)), "training")


TRAIN_COLS = ["turb_id", "wspd", "wdir", "etmp", "itmp", "ndir", "prtv", "patv"]


def _fitted(d, rows):
    return models.train_boosted_trees(
        rows.filter("data_type IN ('train', 'valid')").withColumn("is_valid", F.col("data_type") == "valid"),
        TRAIN_COLS,
        validation="is_valid",
        rounds=6,
        rate=0.2,
        leaves=8,
    )


@query("feature_vector", """SELECT turb_id, slot, dense_rank() OVER (ORDER BY CAST(turb_id AS VARCHAR) || '.0') - 1 AS code,
coalesce(wspd, -9999) AS wspd, coalesce(patv, -9999) AS patv FROM full_panel""", "code wspd patv")
def _(d):
    rows = models.complete(d.full_panel, TRAIN_COLS)
    vectors = Pipeline(stages=models.feature_stages(TRAIN_COLS)).fit(rows).transform(rows)
    x = vector_to_array("features")
    return vectors.select(
        F.col("turb_id").cast("bigint").alias("turb_id"), "slot", x[0].alias("code"), x[1].alias("wspd"), x[7].alias("patv")
    )


@query("train_boosted_trees")
def _(d):
    rows = _training_rows(d)
    test = rows.filter("data_type = 'test'").select(*KEY, "target", *[c for c in TRAIN_COLS if c != "turb_id"])
    return models.predict(_fitted(d, rows), test).select(*KEY, "target", "pred_target")


@query("train_boosted_stump", """WITH b AS (SELECT avg(patv) AS base FROM panel),
c AS (SELECT CAST(unnest(range(1, 15)) AS DOUBLE) AS cut),
h AS (SELECT cut, any_value(base) AS base, count(*) FILTER (WHERE wspd <= cut) AS ln, coalesce(sum(base - patv) FILTER (WHERE wspd <= cut), 0) AS lg,
  count(*) AS n, sum(base - patv) AS g FROM c, b, panel GROUP BY cut),
k AS (SELECT *, CASE WHEN lg > 0 THEN greatest(lg - 0.1, 0) ELSE least(lg + 0.1, 0) END AS l,
  CASE WHEN g - lg > 0 THEN greatest(g - lg - 0.1, 0) ELSE least(g - lg + 0.1, 0) END AS r FROM h),
w AS (SELECT cut, base, -0.5 * l / (ln + 0.1) AS vl, -0.5 * r / (n - ln + 0.1) AS vr FROM k WHERE ln >= 5 AND n - ln >= 5
  ORDER BY l * l / (ln + 0.1) + r * r / (n - ln + 0.1) DESC, cut LIMIT 1)
SELECT turb_id, slot, base + CASE WHEN wspd <= cut THEN vl ELSE vr END AS pred_target FROM panel, w""", "pred_target", 4)
def _(d):
    one = models.BoostSettings(rounds=1, rate=0.5, leaves=2, row_share=1.0, col_share=1.0, min_rows=5)
    rows = stage(d.panel.select(*KEY, "wspd", "patv"), "stump")
    model = models.fit(rows, ["wspd"], "patv", settings=one, borders={"wspd": [float(b) for b in range(1, 15)]})
    return models.predict(model, rows).select(*KEY, "pred_target")


@query("sink_model", f"SELECT turb_id, slot, (({_tree_sql(1)}) + ({_tree_sql(2)})) / 2 AS pred_target FROM panel", "pred_target")
def _(d):
    path = os.path.join(shared_dir(d.spark), f"model-{uuid.uuid4().hex[:12]}")
    src.save_model(models.Booster([(*r, None, None, None) for r in TREE_ROWS], [(1, 2, 1.0, 2.0, True)]), d.spark, path)
    return models.predict_stored(d.panel, src.load_nodes(d.spark, path), "pred_target").select(*KEY, "pred_target")


@query("top_feature_importance")
def _(d):
    return models.feature_importance(_fitted(d, _training_rows(d)), d.spark)


@query("repair_patv_model")
def _(d):
    cols = list(models.REPAIR_INPUTS)
    rows = stage(d.panel, "repairable")
    normal = rows.filter(~sc.abnormal_patv())
    model = models.train_boosted_trees(normal, cols, label="patv", rounds=5, rate=0.3, leaves=8)
    scored = models.predict(model, rows, "prediction")
    return repair.overwrite_abnormal(scored).select(*KEY, "patv")


@query("repair_patv_stored", f"""SELECT turb_id, slot, CASE WHEN {ABNORMAL} THEN (({_tree_sql(1)}) + ({_tree_sql(2)})) / 2 ELSE patv END AS patv
FROM panel""", "patv")
def _(d):
    scored = models.predict_stored(d.panel, d.spark.createDataFrame(TREE_ROWS, TREE_SCHEMA))
    return repair.overwrite_abnormal(scored).select(*KEY, "patv")


# One model of two trees on the farm statistics (fixed node table).
FARM_TREE_ROWS = [
    (1, 0, 0, "patv_mean", 500.0, True, 1, 2, None), (1, 0, 1, "wspd", 7.5, False, 3, 4, None),
    (1, 0, 2, "etmp_median", 15.0, True, 5, 6, None), (1, 0, 3, None, None, None, None, None, -50.0),
    (1, 0, 4, None, None, None, None, None, 450.0), (1, 0, 5, None, None, None, None, None, 800.0),
    (1, 0, 6, None, None, None, None, None, 5000.0), (1, 1, 0, "mask_mean", 0.55, True, 1, 2, None),
    (1, 1, 1, None, None, None, None, None, 10.0), (1, 1, 2, None, None, None, None, None, -10.0),
]


@query("repair_patv_farm_stored", f"""WITH f AS (SELECT m.*, {CURVE_F} AS max_patv FROM masked m LEFT JOIN curve USING (turb_id)),
g AS (SELECT day, tmstamp, avg(patv) FILTER (WHERE mask = 1 AND NOT coalesce(raw_patv > max_patv, false)) AS patv_mean,
  avg(mask) AS mask_mean, median(etmp) AS etmp_median FROM f GROUP BY day, tmstamp),
p AS (SELECT f.*, CASE WHEN coalesce(patv_mean <= 500, true) THEN CASE WHEN coalesce(wspd <= 7.5, false) THEN -50e0 ELSE 450e0 END
  ELSE CASE WHEN coalesce(etmp_median <= 15, true) THEN 800e0 ELSE 5000e0 END END
  + CASE WHEN coalesce(mask_mean <= 0.55, true) THEN 10e0 ELSE -10e0 END AS prediction FROM f JOIN g USING (day, tmstamp)),
q AS (SELECT *, CASE WHEN mask = 0 THEN prediction ELSE patv END AS filled FROM p),
r AS (SELECT *, CASE WHEN filled < 0 THEN 0 ELSE filled END AS low FROM q)
SELECT turb_id, slot, CASE WHEN low > max_patv THEN max_patv ELSE low END AS patv FROM r""", "patv")
def _(d):
    rows = models.farm_repair_inputs(sc.with_clock(d.masked), d.curve, d.panel.select(*KEY, "wdir"))
    scored = models.predict_stored(rows, d.spark.createDataFrame(FARM_TREE_ROWS, TREE_SCHEMA))
    return repair.overwrite_unknown(scored).select(*KEY, "patv")


@query("repair_patv_farm_model")
def _(d):
    rows = stage(models.farm_repair_inputs(sc.with_clock(d.masked), d.curve, d.panel.select(*KEY, "wdir")), "farm-repairable")
    cols = list(models.FARM_REPAIR_INPUTS)
    model = models.train_boosted_trees(rows.filter("mask = 1"), cols, label="patv", rounds=5, rate=0.3, leaves=8)
    scored = models.predict(model, rows, "prediction")
    return repair.overwrite_unknown(scored).select(*KEY, "patv")


PIECES = ((0, 6), (6, 12), (12, OUT))
PAST = f"(PARTITION BY turb_id ORDER BY slot ROWS BETWEEN {IN - 1} PRECEDING AND CURRENT ROW)"
LABELS = ", ".join(
    f"CASE WHEN count(*) OVER s{s} = {e - s} THEN avg(patv) OVER s{s} END AS y{s}" for s, e in PIECES
)
AHEAD = ", ".join(f"s{s} AS (PARTITION BY turb_id ORDER BY slot ROWS BETWEEN {s + 1} FOLLOWING AND {e} FOLLOWING)" for s, e in PIECES)
SAMPLES_SQL = f"""SELECT turb_id, slot AS anchor, last_value(patv IGNORE NULLS) OVER p AS a, avg(wspd) OVER p AS b, count(*) OVER p AS np, {LABELS}
FROM masked WINDOW p AS {PAST}, {AHEAD}"""
# Two inputs: the normal equations have a closed form.
SEGMENT_SQL = f"""WITH x AS (SELECT * FROM ({SAMPLES_SQL}) q WHERE np = {IN}),
l AS ({" UNION ALL ".join(f"SELECT {s} AS seg_start, {e} AS seg_end, a, b, y{s} AS y FROM x" for s, e in PIECES)}),
m AS (SELECT seg_start, seg_end, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
  covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY seg_start, seg_end),
w AS (SELECT *, (bb * (1 + reg) * ay - ab * by_) / (aa * bb * pow(1 + reg, 2) - ab * ab) AS wa,
  (aa * (1 + reg) * by_ - ab * ay) / (aa * bb * pow(1 + reg, 2) - ab * ab) AS wb FROM m, (SELECT unnest([0e0, 1e-1]) AS reg) r)"""


@query("train_segment_models", SEGMENT_SQL + """ SELECT turb_id, anchor, CAST(seg_start AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end, reg,
my + wa * (coalesce(a, ma) - ma) + wb * (coalesce(b, mb) - mb) AS yhat FROM x, w""", "yhat", 4)
def _(d):
    samples = stage(segments.segment_samples(d.masked, (IN,), PIECES, 24), "samples")
    fitted = segments.train_segment_models(samples, PIECES, IN, window=("last_patv", "mean_wspd"), other=())
    return segments.score_segment_models(samples, fitted, ("turb_id", "anchor"))


@query("segment_samples", f"""SELECT turb_id, anchor, a AS last_patv_{IN}, mp AS mean_patv_{IN}, b AS mean_wspd_{IN}, k / {IN}e0 AS known_share_{IN},
{", ".join(f"y{s} AS y_{s}_{e}" for s, e in PIECES)} FROM (SELECT *, avg(patv) OVER {PAST} AS mp, count(patv) OVER {PAST} AS k
FROM masked) m JOIN ({SAMPLES_SQL}) q ON q.turb_id = m.turb_id AND q.anchor = m.slot WHERE np = {IN}""".replace("SELECT turb_id, anchor, a AS", "SELECT q.turb_id, anchor, a AS"),
       f"last_patv_{IN} mean_patv_{IN} mean_wspd_{IN} known_share_{IN} " + " ".join(f"y_{s}_{e}" for s, e in PIECES), 4)
def _(d):
    return segments.segment_samples(d.masked, (IN,), PIECES, 24).drop("hour_sin", "hour_cos")


@query("train_grid_models")
def _(d):
    grids = {"main": models.GRID_MAIN | {"partial_days": (None, 14)}, "temperature": models.GRID_TEMPERATURE | {"partial_days": (None, 14)}}
    grid = [r.asDict() for r in models.grid_rows(d.spark, grids, 24).collect()]  # one row a configuration
    ends = sorted({g["output_len"] for g in grid if g["grid"] == "main"})
    places = dict(zip(ends, zip([0, *ends], ends))) | {108: (72, 108), 216: (144, 216)}
    lens = sorted({g["days"] * 24 for g in grid})
    samples = stage(segments.segment_samples(d.masked, lens, sorted(set(places.values())), 24, ("day",)), "samples")
    fitted = segments.train_grid_models(samples, grid, 24, places)
    rows = [(g["grid"], i, m.part.segment[0], m.part.segment[1], m.part.input_len, m.part.last_day, m.regularisation, m.samples, m.intercept) for i, (g, m) in enumerate(zip(grid, fitted, strict=True))]
    return d.spark.createDataFrame(rows, "grid string, nth long, seg_start long, seg_end long, input_len long, last_day long, reg double, samples long, intercept double")


# ---- forecast blending


@query("horizon_segments", "SELECT model_id, seg_start, seg_end FROM segments")
def _(d):
    return blend.horizon_segments(d.lengths)


SEG_SQL = """SELECT turb_id, step, seg_start, seg_end, median(yhat) AS yhat FROM preds JOIN segments USING (model_id)
WHERE step >= seg_start AND step < seg_end GROUP BY turb_id, step, seg_start, seg_end"""


@query("segment_median", SEG_SQL, "yhat")
def _(d):
    return blend.segment_median(d.preds, blend.horizon_segments(d.lengths))


@query("segment_concat", f"SELECT turb_id, step, yhat FROM ({SEG_SQL}) s", "yhat")
def _(d):
    return blend.segment_concat(d.preds, blend.horizon_segments(d.lengths))


LAST = f"""SELECT turb_id, median(patv) AS last FROM panel WHERE slot >= (SELECT min(slot) FROM
(SELECT DISTINCT slot FROM panel ORDER BY slot DESC LIMIT {LOOKBACK}) x) GROUP BY turb_id"""


@query("anchor_adjust", f"""SELECT model_id, turb_id, step,
CASE WHEN step < 60 THEN yhat + coalesce(last - yhat, 0) * pow((step - 60) / 60e0, 2) ELSE yhat END AS yhat
FROM preds LEFT JOIN ({LAST}) l USING (turb_id)""", "yhat")
def _(d):
    return blend.anchor_adjust(d.preds, d.panel.select(*KEY, "patv"), 60, LOOKBACK)


@query("residual_decay_adjust", f"""SELECT turb_id, time, CASE WHEN sh < 0.6 THEN mp + (mt - mp) * pow(greatest({FADE} - time % {H}, 0) / {FADE}e0, 2)
ELSE yhat END AS pred_target FROM (SELECT e.*, s.mt, s.mp, s.sh FROM evaluated e LEFT JOIN (
  SELECT turb_id, time // {H} + 1 AS block, avg(CASE WHEN NOT abnormal THEN y END) AS mt, avg(CASE WHEN NOT abnormal THEN yhat END) AS mp,
  sum(CASE WHEN abnormal THEN 1 ELSE 0 END) / {LOOKBACK}e0 AS sh FROM evaluated WHERE time % {H} >= {H - LOOKBACK} GROUP BY 1, 2) s
ON s.turb_id = e.turb_id AND s.block = e.time // {H}) j""", "pred_target")
def _(d):
    rows = d.evaluated.withColumnsRenamed({"yhat": "pred_target", "y": "target"})
    return blend.residual_decay_adjust(rows, H, LOOKBACK, FADE).select("turb_id", "time", "pred_target")


MODEL = ("model_id",)


# Every model's forecast, without its last steps, next to that of the following model, which begins later.
@query("blend_legs", f"""SELECT model_id, turb_id, step, CASE WHEN step >= 200 THEN coalesce(0.5 * a.yhat + 0.5 * b.yhat, a.yhat, b.yhat)
  ELSE coalesce(a.yhat, b.yhat) END AS yhat FROM (SELECT * FROM preds WHERE step < {STEPS - 8}) a
FULL JOIN (SELECT (model_id + 13) % 15 + 1 AS model_id, turb_id, step, yhat FROM preds WHERE step >= 150) b USING (model_id, turb_id, step)""", "yhat")
def _(d):
    long = d.preds.filter("step >= 150").withColumn("model_id", (F.col("model_id") + 13) % 15 + 1)
    return blend.blend_legs(d.preds.filter(F.col("step") < STEPS - 8), long, by=MODEL)


@query("add_jitter", """SELECT model_id, turb_id, step, yhat + sqrt(-2 * ln(((turb_id * 7919 + step * 104729 + model_id * 13) % 9973 + 1) / 9974.0))
* cos(2 * pi() * ((turb_id * 31 + step * 17) % 1009 + 1) / 1010.0) * 0.015 AS yhat FROM preds""", "yhat")
def _(d):
    radius = ((F.col("turb_id") * 7919 + F.col("step") * 104729 + F.col("model_id") * 13) % 9973 + 1) / 9974.0
    angle = ((F.col("turb_id") * 31 + F.col("step") * 17) % 1009 + 1) / 1010.0
    return blend.add_jitter(d.preds.select("model_id", *STEP, "yhat"), draws=(radius, angle), by=MODEL)


@query("forecast_layout", """SELECT model_id, turb_id, count(*) AS n, min_by(yhat, step) AS first, max_by(yhat, step) AS last
FROM preds GROUP BY model_id, turb_id""", "first last")
def _(d):
    f = F.col("forecast")
    out = blend.forecast_layout(d.preds, STEPS, MODEL)
    return out.select("model_id", "turb_id", F.size(f).cast("bigint").alias("n"), f[0].alias("first"), f[STEPS - 1].alias("last"))


# ---- metrics

DY = "(SELECT *, y - avg(y) OVER t AS dy, yhat - avg(yhat) OVER t AS dp FROM scored WINDOW t AS (PARTITION BY turb_id)) c"
ROUNDED = {
    "mae": "avg(abs(yhat - y))",
    "mse": "avg(pow(yhat - y, 2))",
    "rmse": "sqrt(avg(pow(yhat - y, 2)))",
    "mape": "avg(abs((yhat - y) / nullif(y, 0)))",
    "mspe": "avg(pow((yhat - y) / nullif(y, 0), 2))",
}


def _plain(name, fn):
    query(f"metric_{name}", f"SELECT model_id, {ROUNDED[name]} AS {name} FROM scored GROUP BY model_id", name, 5)(
        lambda d: d.scored.groupBy("model_id").agg(fn().alias(name))
    )


for _name in ROUNDED:
    _plain(_name, getattr(metrics, _name))


@query("metric_rse", """SELECT model_id, sqrt(sum(pow(y - yhat, 2))) / sqrt(sum(pow(y - m, 2))) AS rse
FROM (SELECT *, avg(y) OVER (PARTITION BY model_id) AS m FROM scored) s GROUP BY model_id""", "rse")
def _(d):
    return d.scored.groupBy("model_id").agg(metrics.rse().alias("rse"))


@query("metric_corr", f"""SELECT avg(c) AS corr_product, avg(r) AS corr FROM (SELECT turb_id,
sum(dy * dp) / sqrt(sum(pow(dy * dp, 2))) AS c, corr(y, yhat) AS r FROM {DY} GROUP BY turb_id) p""", "corr_product corr")
def _(d):
    return metrics.corr_product(d.scored)


@query("metric_bundle", f"SELECT {', '.join(f'{sql} AS {n}' for n, sql in ROUNDED.items())} FROM scored", " ".join(ROUNDED), 5)
def _(d):
    return d.scored.agg(*metrics.bundle())


WINDOW_SCORES = f"""SELECT turb_id, time, a / nullif(n, 0) AS mae, sqrt(q / nullif(n, 0)) AS rmse FROM (SELECT turb_id, time,
sum(CASE WHEN abnormal THEN 0 ELSE 1 END) OVER w AS n, sum(CASE WHEN abnormal THEN 0 ELSE abs(yhat - y) / 1000 END) OVER w AS a,
sum(CASE WHEN abnormal THEN 0 ELSE pow((yhat - y) / 1000, 2) END) OVER w AS q, count(*) OVER w AS k FROM evaluated
WINDOW w AS (PARTITION BY turb_id ORDER BY time ROWS {H - 1} PRECEDING)) s WHERE k = {H}"""


@query("score_sliding", f"""SELECT avg(mae) AS mae, avg(rmse) AS rmse, (avg(mae) + avg(rmse)) / 2 AS score FROM (
SELECT time, coalesce(sum(mae), 0) AS mae, coalesce(sum(rmse), 0) AS rmse FROM ({WINDOW_SCORES}) t GROUP BY time) u""", "mae rmse score")
def _(d):
    return metrics.score_sliding(d.evaluated, H)


PER_TURB = """SELECT model_id, turb_id, sqrt(sum(pow((y - yhat) / 1000, 2) * mask) / {n}) AS r, sum(abs(y - yhat) / 1000 * mask) / {n} AS m
FROM scored GROUP BY model_id, turb_id"""


@query("score_fixed_len", f"""SELECT avg(s) AS score, sum(r) / sum(k) AS rmse, sum(m) / sum(k) AS mae FROM (
SELECT model_id, sum(0.5 * r + 0.5 * m) AS s, sum(r) AS r, sum(m) AS m, count(*) AS k FROM ({PER_TURB.format(n=STEPS)}) p GROUP BY model_id) x""",
       "score rmse mae")
def _(d):
    return metrics.score_fixed_len(d.scored, STEPS, ["model_id"])


@query("score_masked_len", f"""SELECT avg(s) AS score, avg(r) AS rmse, avg(m) AS mae FROM (
SELECT model_id, sum(0.5 * r + 0.5 * m) AS s, sum(r) AS r, sum(m) AS m FROM ({PER_TURB.format(n="(sum(mask) + 0.0001)")}) p GROUP BY model_id) x""",
       "score rmse mae")
def _(d):
    return metrics.score_masked_len(d.scored, ["model_id"])


@query("loss_masked_mean", "SELECT model_id, sum(pow(yhat - y, 2) * mask) / (sum(mask) + 0.0001e0) AS loss FROM scored GROUP BY model_id", "loss", 4)
def _(d):
    return d.scored.groupBy("model_id").agg(metrics.loss_masked_mean().alias("loss"))


@query("total_power_error", """SELECT avg(r) AS rmse, avg(m) AS mae FROM (SELECT model_id, sqrt(avg(pow(yhat - y, 2))) AS r, avg(abs(yhat - y)) AS m
FROM (SELECT model_id, step, sum(y) / 1000 AS y, sum(yhat) / 1000 AS yhat FROM scored GROUP BY model_id, step) t GROUP BY model_id) u""", "rmse mae")
def _(d):
    return metrics.total_power_error(d.scored, ["model_id"])


@query("flatness_check", """SELECT * FROM (SELECT model_id, avg(s) AS std_time FROM (SELECT model_id, stddev_pop(yhat) AS s FROM preds GROUP BY model_id, turb_id) a
GROUP BY model_id) t JOIN (SELECT model_id, avg(s) AS std_turbines FROM (SELECT model_id, stddev_pop(yhat) AS s FROM preds GROUP BY model_id, step) b
GROUP BY model_id) u USING (model_id)""", "std_time std_turbines", 5)
def _(d):
    return blend.flatness(d.preds, MODEL)
