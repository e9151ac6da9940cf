"""Samples scaled by their own normalisers against a plain loop over samples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeolis.operators import sample_scale as ss

IN, OUT = 12, 5
KEY = ["turb_id", "feature"]


@pytest.fixture(scope="module")
def series(panel):
    rows = panel.select("turb_id", F.col("time").alias("slot"), "patv", (F.col("time") * 2 % 7).alias("wspd"))
    return rows.withColumn("calm", F.when(F.col("slot") > 30, 4.0)).persist()


COLS = ["patv", "wspd", "calm"]


def plain(pdf, output_len):
    out = []
    for turb, g in pdf.groupby("turb_id"):
        g = g.sort_values("slot")
        for c in COLS:
            x = g[c].to_numpy(float)
            for a in range(IN - 1, len(x) - output_len):
                inputs = x[a + 1 - IN : a + 1]
                known = inputs[~np.isnan(inputs)]
                mean, std = (known.mean(), known.std()) if len(known) else (np.nan, np.nan)
                z = (x[a + 1 - IN : a + 1 + output_len] - mean) / (std if std > 0 else np.nan)
                out += [(turb, c, a, 1 - IN + i, v) for i, v in enumerate(z)]
    return pd.DataFrame(out, columns=[*KEY, "anchor", "offset", "value"])


def scaled(rows, output_len, size=256):
    return ss.scale_samples(
        rows.unpivot(["turb_id", "slot"], [F.col(c).cast("double").alias(c) for c in COLS], "feature", "value"),
        ss.column_norm(rows, COLS, IN, size=size), IN, output_len, KEY, size=size,
    )


@pytest.mark.parametrize("output_len,size", [(OUT, 8), (OUT, 256), (0, 50)])
def test_columns_of_samples(series, output_len, size):
    order = [*KEY, "anchor", "offset"]
    got = scaled(series, output_len, size).toPandas().sort_values(order).reset_index(drop=True)
    want = plain(series.toPandas(), output_len).sort_values(order).reset_index(drop=True)
    assert (got[order] == want[order]).all().all()
    np.testing.assert_allclose(got["value"].astype(float), want["value"], rtol=1e-6, atol=1e-6)
    # a column that never moves has no scale
    assert got.loc[got["feature"] == "calm", "value"].isna().all()


def test_predictions_go_back(series):
    norm = ss.column_norm(series, ["patv"], IN)
    z = scaled(series, OUT).filter("feature = 'patv' AND offset > 0 AND value IS NOT NULL")
    back = ss.unscale_samples(z, norm, KEY, "value").withColumn("slot", F.col("anchor") + F.col("offset"))
    wrong = back.join(series, ["turb_id", "slot"]).filter("value IS NULL OR abs(value - patv) > 1e-6")
    assert wrong.count() == 0 and back.count() == z.count() > 0


def test_turbines_share_the_pooled_statistics(spark):
    values = spark.createDataFrame(
        [(1, t, s, None if (t, s) == (2, 3) else float(10 * t + s * s)) for t in (1, 2) for s in range(6)],
        "farm_id int, turb_id bigint, slot bigint, patv double",
    )
    edges = spark.createDataFrame([("all", 1), ("all", 2)], "group_id string, turb_id bigint")
    norm = {(r["node"], r["anchor"]): r for r in ss.node_norm(values, edges, 3).collect()}
    assert sorted(norm) == sorted((n, a) for n in ("all", "t1", "t2") for a in range(2, 6))
    pooled = np.array([11.0, 14, 19, 21, 24])  # slots 1 to 3
    for n in ("t1", "t2"):
        np.testing.assert_allclose([norm[n, 3]["mean"], norm[n, 3]["std"]], [pooled.mean(), pooled.std()])
    np.testing.assert_allclose([norm["all", 3]["mean"], norm["all", 3]["std"]], [2 * pooled.mean(), np.std([32.0, 38, 19])])


def test_nothing_to_scale(series):
    for rows in (series.limit(0), series.filter(F.col("slot") < IN - 1)):
        assert scaled(rows, OUT).count() == 0
