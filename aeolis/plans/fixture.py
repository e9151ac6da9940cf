"""The sensor panel derived from the ``events`` table, and views on it; one DataFrame and one SQL text each.

Thirty users make one turbine, so that the panel grows with the table. Steps are hourly, 24 per day; windows of
288 / 432 / 144 steps become 24 / 96 / 24.
"""

from __future__ import annotations

import os
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolis.functions import scalar as sc
from aeolis.operators import gaps
from aeolis.operators.blocks import step_index
from aeolis.operators.rolling import seasonal_residual
from aeolis.operators.split_scale import drop_horizon_tail, split_by_day, with_label
from aeolis.session import shared_dir
from aeolis.sources.panel import MEASURES

STEPS_PER_DAY = 24
H = 24
W = 96
#: Window of the series features, as the stored models have it.
SERIES = 432
LOOKBACK = 10
FADE = 8
VALID_DAYS = 5
TEST_DAYS = 5
MODELS = 15
OUTPUT_LENGTHS = (12, 36, 72, 144, 288)
STEPS = 288

# Measures as integer arithmetic on cents, so that every engine gets the same doubles (fixed definitions).
MEASURE_SQL = {
    "wspd": "CAST(sum(c) % 1500 AS DOUBLE) / 1e2",
    "wdir": "CAST(sum(c * 3) % 40000 AS DOUBLE) / 1e2 - 2e2",
    "etmp": "CAST(max(c) % 6000 AS DOUBLE) / 1e2 - 2e1",
    "itmp": "CAST(min(c) % 6000 AS DOUBLE) / 1e2 - 1e1",
    "ndir": "CAST(sum(event_id * 17) % 160000 AS DOUBLE) / 1e2 - 8e2",
    "pab1": "CAST(sum(c * 11) % 9500 AS DOUBLE) / 1e2",
    "pab2": "CAST(sum(c * 13) % 9100 AS DOUBLE) / 1e2",
    "pab3": "CAST(sum(c * 19) % 9100 AS DOUBLE) / 1e2",
    "prtv": "CAST(sum(c * 5) % 30000 AS DOUBLE) / 1e2 - 5e1",
    "patv": "CAST(sum(c * 7) % 160000 AS DOUBLE) / 1e2 - 5e1",
}
ALL = ", ".join(MEASURES)
SENSORS = (
    "coalesce(pab1 > 89, false) OR coalesce(pab2 > 89, false) OR coalesce(pab3 > 89, false) "
    "OR coalesce(wdir < -180 OR wdir > 180, false) OR coalesce(ndir < -720 OR ndir > 720, false)"
)
ABNORMAL = f"(coalesce(patv <= 0 AND wspd > 2.5, false) OR {SENSORS})"
ABNORMAL_EVAL = f"(coalesce(patv < 0, false) OR {ABNORMAL})"
UNKNOWN = f"(patv IS NULL OR patv <= 0 OR {SENSORS})"
CURVE_F = "CASE WHEN wspd >= 0 THEN least(a * pow(wspd, beta) + b * wspd, mx) END"
BUCKET = "CASE WHEN wspd <= 2.5 THEN 0.0 WHEN wspd >= 10 THEN 10.0 ELSE floor(wspd / 0.5) * 0.5 END"

CTES = {
    "panel": f"""
SELECT turb_id, slot, day, hour, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS tmstamp,
  {", ".join(f"{sql} AS {m}" for m, sql in MEASURE_SQL.items())}
FROM (SELECT CAST(user_id // 30 + 1 AS BIGINT) AS turb_id, CAST(day(ts) AS BIGINT) AS day,
             CAST(hour(ts) AS BIGINT) AS hour, CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT) AS slot, event_id,
             CAST(round(value * 100) AS BIGINT) AS c FROM events) e
GROUP BY turb_id, day, hour, slot""",
    "turbines": "SELECT DISTINCT turb_id FROM panel",
    "grid": "SELECT unnest(range(lo, hi + 1)) AS slot FROM (SELECT min(slot) AS lo, max(slot) AS hi FROM panel) b",
    "spine": """SELECT turb_id, slot, slot // 24 + 1 AS day, lpad(CAST(slot % 24 AS VARCHAR), 2, '0') || ':00' AS tmstamp
FROM turbines, grid""",
    "full_panel": f"""SELECT s.turb_id, s.slot, s.day, s.tmstamp, {", ".join("p." + m for m in MEASURES)}
FROM spine s LEFT JOIN panel p ON p.turb_id = s.turb_id AND p.slot = s.slot""",
    "stepped": "SELECT *, row_number() OVER (PARTITION BY turb_id ORDER BY slot) - 1 AS time FROM panel",
    "curve": """SELECT turb_id, CAST(1.9e1 + turb_id AS DOUBLE) AS a, 1.9e0 AS beta, 1e-3 AS b,
  CAST(1500 + 10 * turb_id AS DOUBLE) AS mx FROM turbines""",
    "angle": "SELECT turb_id, CAST((turb_id - 1) * 35 AS DOUBLE) AS diff_angle FROM turbines",
    "masked": f"""SELECT turb_id, slot, day, tmstamp, wspd, etmp, itmp, CASE WHEN {UNKNOWN} THEN 0 ELSE 1 END AS mask,
  CASE WHEN {UNKNOWN} THEN NULL ELSE patv END AS patv, patv AS raw_patv FROM full_panel""",
    "basis": f"""SELECT *, {CURVE_F} AS max_patv, {CURVE_F} - patv AS patv_residual, ndir + wdir AS w_angle,
  ndir + wdir + diff_angle AS w_angle_adj, sin(radians(ndir + wdir + diff_angle)) AS w_angle_sin,
  cos(radians(ndir + wdir + diff_angle)) AS w_angle_cos
FROM stepped LEFT JOIN curve USING (turb_id) LEFT JOIN angle USING (turb_id)""",
    "labelled": f"""SELECT turb_id, slot, day, tmstamp, time, wspd, etmp, patv,
  lead(patv, 24) OVER (PARTITION BY turb_id ORDER BY time) AS target,
  lead({ABNORMAL_EVAL}, 24) OVER (PARTITION BY turb_id ORDER BY time) AS abnormal FROM stepped""",
    "days": "SELECT day, row_number() OVER (ORDER BY day DESC) AS rn FROM (SELECT DISTINCT day FROM panel) d",
    "split": """SELECT l.*, CAST((turb_id - 1) * 35 AS DOUBLE) AS diff_angle, CASE WHEN target IS NULL THEN 'pred'
  WHEN day >= (SELECT day FROM days WHERE rn = 7) THEN 'test'
  WHEN day >= (SELECT day FROM days WHERE rn = 12) THEN 'valid' ELSE 'train' END AS data_type FROM labelled l""",
    "evaluated": """SELECT turb_id, time, patv AS yhat, target AS y, abnormal FROM labelled WHERE target IS NOT NULL""",
    "hier": """SELECT 'total' AS group_id, turb_id FROM turbines
UNION ALL SELECT 'mod' || CAST(turb_id % 3 AS VARCHAR), turb_id FROM turbines
UNION ALL SELECT 'odd', turb_id FROM turbines WHERE turb_id % 2 = 1""",
    "models": """SELECT m AS model_id, CAST(CASE (m - 1) // 3 WHEN 0 THEN 12 WHEN 1 THEN 36 WHEN 2 THEN 72 WHEN 3 THEN 144
  ELSE 288 END AS BIGINT) AS output_len FROM (SELECT unnest(range(1, 16)) AS m) r""",
    "preds": """SELECT m.model_id, p.turb_id, s.step,
  greatest(p.patv + CAST((s.step * 37 + p.turb_id * 53 + m.model_id * 101) % 401 - 200 AS DOUBLE), 0e0) AS yhat
FROM (SELECT turb_id, max_by(patv, slot) AS patv FROM panel GROUP BY turb_id) p, models m,
  (SELECT unnest(range(0, 288)) AS step) s""",
    "scored": f"""SELECT model_id, turb_id, step, yhat, patv AS y, CASE WHEN {UNKNOWN} THEN 0 ELSE 1 END AS mask
FROM preds JOIN stepped USING (turb_id) WHERE step = time""",
    "lengths": """SELECT model_id, max(step) + 1 AS output_len FROM preds JOIN models USING (model_id)
WHERE step < output_len GROUP BY model_id""",
    "segments": """SELECT model_id, CAST(CASE output_len WHEN 12 THEN 0 WHEN 36 THEN 12 WHEN 72 THEN 36 WHEN 144 THEN 72
  ELSE 144 END AS BIGINT) AS seg_start, output_len AS seg_end FROM lengths""",
    "pool": f"""SELECT {BUCKET} AS ws_bucket,
  row_number() OVER (PARTITION BY {BUCKET} ORDER BY turb_id, slot) - 1 AS rn, patv FROM masked WHERE mask = 1""",
    "series": f"""SELECT e.turb_id, e.slot AS time, s.slot - e.slot + {SERIES - 1} AS i, coalesce(s.patv, 0) AS x
FROM full_panel e JOIN full_panel s ON s.turb_id = e.turb_id AND s.slot BETWEEN e.slot - {SERIES - 1} AND e.slot
WHERE e.slot >= {SERIES - 1}""",
}


class Fixture:
    """The views as DataFrames, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str, users_per_turbine: int = 30):
        self.spark, self.sf_dir, self.per = spark, sf_dir, users_per_turbine
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    @cached_property
    def panel(self) -> DataFrame:
        events = self.spark.read.parquet(os.path.join(self.sf_dir, "events.parquet"))
        day, hour = F.day("ts").cast("bigint"), F.hour("ts").cast("bigint")
        cells = events.select(
            F.floor(F.col("user_id") / self.per + 1).cast("bigint").alias("turb_id"),
            ((day - 1) * STEPS_PER_DAY + hour).alias("slot"),
            day.alias("day"),
            hour.alias("hour"),
            "event_id",
            F.round(F.col("value") * 100).cast("bigint").alias("c"),
        )
        measures = [F.expr(sql).alias(m) for m, sql in MEASURE_SQL.items()]
        clock = F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00"))
        return cells.groupBy("turb_id", "slot", "day", "hour").agg(*measures).withColumn("tmstamp", clock)

    @cached_property
    def panel_path(self) -> str:
        """The panel written as a table with the sensor file's column names."""
        path = os.path.join(shared_dir(self.spark), f"panel-{uuid.uuid4().hex[:12]}")
        names = {"turb_id": "TurbID", "day": "Day", "tmstamp": "Tmstamp", **{m: m.capitalize() for m in MEASURES}}
        self.panel.select(*[F.col(c).alias(n) for c, n in names.items()]).write.parquet(path)
        return path

    @cached_property
    def turbines(self) -> DataFrame:
        return self.panel.select("turb_id").distinct()

    @cached_property
    def full_panel(self) -> DataFrame:
        return gaps.fill_missing_slots(self.panel, STEPS_PER_DAY)

    @cached_property
    def stepped(self) -> DataFrame:
        return step_index(self.panel)

    @cached_property
    def curve(self) -> DataFrame:
        t = F.col("turb_id")
        return self.turbines.select(
            t,
            (t + 19).cast("double").alias("a"),
            F.lit(1.9).alias("beta"),
            F.lit(1e-3).alias("b"),
            (1500 + 10 * t).cast("double").alias("mx"),
        )

    @cached_property
    def angle(self) -> DataFrame:
        return self.turbines.select("turb_id", ((F.col("turb_id") - 1) * 35).cast("double").alias("diff_angle"))

    @cached_property
    def masked(self) -> DataFrame:
        keep = ("turb_id", "slot", "day", "tmstamp", "wspd", "etmp", "itmp", "mask", "patv", "raw_patv")
        return sc.with_unknown_mask(self.full_panel.withColumn("raw_patv", F.col("patv"))).select(*keep)

    @cached_property
    def basis(self) -> DataFrame:
        return sc.with_wind_angle(sc.with_residual(sc.with_curve(self.stepped, self.curve)), self.angle)

    @cached_property
    def labelled(self) -> DataFrame:
        rows = self.stepped.withColumn("abnormal", sc.abnormal_eval())
        keep = ("turb_id", "slot", "day", "tmstamp", "time", "wspd", "etmp", "patv", "abnormal")
        return with_label(rows.select(*keep), H)

    @cached_property
    def split(self) -> DataFrame:
        rows = self.labelled.join(self.angle, "turb_id", "left")
        return split_by_day(rows, VALID_DAYS, TEST_DAYS, calendar=self.panel)

    @cached_property
    def evaluated(self) -> DataFrame:
        """Persistence forecast next to the truth."""
        return drop_horizon_tail(self.labelled, H).select(
            "turb_id", "time", F.col("patv").alias("yhat"), F.col("target").alias("y"), "abnormal"
        )

    @cached_property
    def hier(self) -> DataFrame:
        t = F.col("turb_id")
        groups = F.array(
            F.lit("total"), F.concat(F.lit("mod"), (t % 3).cast("string")), F.when(t % 2 == 1, F.lit("odd"))
        )
        return self.turbines.select(F.explode(F.array_compact(groups)).alias("group_id"), "turb_id")

    @cached_property
    def lengths(self) -> DataFrame:
        """(model_id, output_len) read off the forecasts, each model cut to the length it is meant for."""
        lengths = F.array(*[F.lit(n).cast("bigint") for n in OUTPUT_LENGTHS])
        meant = F.get(lengths, F.floor((F.col("model_id") - 1) / 3).cast("int"))
        own = self.preds.filter(F.col("step") < meant)
        return own.groupBy("model_id").agg((F.max("step") + 1).alias("output_len"))

    @cached_property
    def preds(self) -> DataFrame:
        newest = self.panel.groupBy("turb_id").agg(F.max_by("patv", "slot").alias("patv"))
        rows = newest.withColumn("model_id", F.explode(F.sequence(F.lit(1), F.lit(MODELS)))).withColumn(
            "step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))
        )
        m, t, s = (F.col(c).cast("bigint") for c in ("model_id", "turb_id", "step"))
        noise = ((s * 37 + t * 53 + m * 101) % 401 - 200).cast("double")
        return rows.select(
            m.alias("model_id"), "turb_id", s.alias("step"), F.greatest(F.col("patv") + noise, F.lit(0.0)).alias("yhat")
        )

    @cached_property
    def scored(self) -> DataFrame:
        mask = F.when(sc.unknown_patv(), 0).otherwise(1)
        truth = self.stepped.select("turb_id", F.col("time").alias("step"), F.col("patv").alias("y"), mask.alias("mask"))
        # Spark takes the unrolled forecasts to be as small as the one row a turbine they come from, and would broadcast them
        return self.preds.hint("merge").join(truth, ["turb_id", "step"])

    @cached_property
    def history(self) -> DataFrame:
        return self.full_panel.select("turb_id", "slot", "patv")

    @cached_property
    def farmed(self) -> DataFrame:
        return self.full_panel.withColumn("farm_id", F.lit(1))

    def seasonal(self) -> DataFrame:
        return seasonal_residual(self.stepped, H)
