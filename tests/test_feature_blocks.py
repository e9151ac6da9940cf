"""The one-pass block of the long leg against its parts, with blocks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeolis.operators.feature_blocks import long_leg_blocks
from aeolis.operators.rolling import roll_bundle
from aeolis.operators.series import series_features
from aeolis.operators.split_scale import with_label

KEYS = ["turb_id", "time"]
FEATURES = ("wspd", "patv")
ROLL, SERIES, HORIZON = 30, 48, 9


@pytest.fixture(scope="module")
def rows(panel):
    wind = F.abs(F.hash("turb_id", "time") % 2000) / 100
    flag = F.when(F.col("time") % 17 != 0, F.col("time") % 5 == 0)
    return panel.withColumns({"wspd": wind, "abnormal": flag, "tag": F.concat(F.lit("t"), F.col("time").cast("string"))})


def parts(rows):
    """The same columns by three operators and two joins."""
    rolled = roll_bundle(rows, FEATURES, [ROLL])
    rolled = rolled.withColumn("seasonal_patv", F.col("patv") - F.col(f"win{ROLL}_mean_patv"))
    labels = with_label(rows.select(*KEYS, "patv", "abnormal"), HORIZON).drop("patv")
    return rolled.drop("abnormal").join(series_features(rows, SERIES), KEYS).join(labels, KEYS)


@pytest.mark.parametrize("size", [16, 100, 4096])
def test_equals_its_parts(rows, size):
    got = long_leg_blocks(rows, FEATURES, ROLL, SERIES, HORIZON, size=size)
    want = parts(rows)
    assert set(got.columns) == set(want.columns)
    a, b = (d.toPandas().sort_values(KEYS).reset_index(drop=True) for d in (got, want))
    # every turbine has as many rows as it has full windows
    assert len(a) == len(b) == sum(n - SERIES + 1 for n in (700, 120, 90))
    for c in b.columns:
        if c in ("tag", "abnormal"):
            assert a[c].where(a[c].notna(), None).tolist() == b[c].where(b[c].notna(), None).tolist(), c
        else:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-7, atol=1e-6, err_msg=c)


def test_label_ends_with_the_series(rows, panel_pdf):
    got = long_leg_blocks(rows, FEATURES, ROLL, SERIES, HORIZON, size=16).select(*KEYS, "target", "abnormal").toPandas()
    want = panel_pdf.assign(target=panel_pdf.groupby("turb_id")["patv"].shift(-HORIZON))
    both = got.merge(want, on=KEYS, suffixes=("", "_want"))
    assert len(both) == len(got)
    np.testing.assert_allclose(both["target"], both["target_want"])
    last = panel_pdf.groupby("turb_id")["time"].max()
    behind = both["time"] > both["turb_id"].map(last) - HORIZON
    assert both.loc[behind, "abnormal"].isna().all() and behind.sum() == 3 * HORIZON


def test_wide_rows_move_once(rows):
    plan = long_leg_blocks(rows, FEATURES, ROLL, SERIES, HORIZON)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_short_and_empty_series(rows):
    few = rows.filter(F.col("time") < SERIES - 1)
    for part in (few, rows.limit(0)):
        out = long_leg_blocks(part, FEATURES, ROLL, SERIES, HORIZON)
        assert out.toPandas().empty and out.schema["target"].dataType.simpleString() == "double"


def test_without_the_mask_and_extra_columns(rows):
    out = long_leg_blocks(rows.drop("abnormal"), ("wspd",), ROLL, SERIES, HORIZON).toPandas()
    assert "abnormal" not in out and "seasonal_patv" not in out and isinstance(out, pd.DataFrame)
    assert (out["tag"] == "t" + out["time"].astype(str)).all()
