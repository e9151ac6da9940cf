"""Queries on forecasts next to the truth: the forecasts, thousands of rows a turbine, never go through the driver."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from aeolis.plans.fixture import MODELS, STEPS

TURBINES, READINGS = 2, 300
EVENTS = f"""SELECT i AS event_id, TIMESTAMP '2024-01-01 00:05:00' + to_minutes(CAST(i * 37 AS BIGINT)) AS ts, i % {30 * TURBINES} AS user_id,
'view' AS event_type, (i * 7919 % 56100) / 1e2 AS value, NULL::VARCHAR AS props FROM range({READINGS}) r(i)"""


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    con = duckdb.connect()
    con.execute(f"COPY ({EVENTS}) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return folder, con


@pytest.mark.parametrize("name", [
    "loss_masked_mean",
    "metric_bundle",
    "masked_loss",
    "metric_corr",
    "metric_mae",
    "metric_mape",
    "metric_mse",
    "metric_mspe",
    "metric_rmse",
    "metric_rse",
    "score_fixed_len",
    "score_masked_len",
    "total_power_error",
])
def test_forecasts_are_not_broadcast(spark, events, name):
    folder, con = events
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    sent = [float(n) for n in re.findall(r"BroadcastQueryStage[^\n]*rowCount=([\d.E+]+)", plan)]
    assert "rowCount=" in plan and max(sent, default=0) < TURBINES * MODELS * STEPS
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = sorted(want.fetchall())
    assert rows and sorted(tuple(r[c] for c in names) for r in got) == [pytest.approx(r) for r in rows]
