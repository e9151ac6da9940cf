"""Blocked windows against pandas, with blocks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeolis.operators import blocks, gaps, rolling


def collect(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def by_turbine(pdf, fn):
    return pd.concat([fn(g) for _, g in pdf.groupby("turb_id")]).reset_index(drop=True)


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_step_index(panel, panel_pdf, size):
    got = collect(blocks.step_index(panel.drop("time"), size=size), "turb_id", "slot")
    assert (got["time"] == panel_pdf["time"]).all()


@pytest.mark.parametrize("size", [5, 50])
def test_shift(panel, panel_pdf, size):
    got = collect(blocks.shift(panel, {"ahead": ("patv", 24), "back": ("patv", -3)}, size=size), "turb_id", "time")
    assert len(got) == len(panel_pdf)
    np.testing.assert_allclose(got["ahead"], panel_pdf.groupby("turb_id")["patv"].shift(-24))
    np.testing.assert_allclose(got["back"], panel_pdf.groupby("turb_id")["patv"].shift(3))


@pytest.mark.parametrize("size", [4, 33])
def test_neighbours(panel, panel_pdf, size):
    got = collect(blocks.neighbours(panel, ["patv"], size=size), "turb_id", "time")
    value = lambda c: got[c].map(lambda r: np.nan if r is None else r["value"]).astype(float)
    np.testing.assert_allclose(value("_prev_patv"), panel_pdf.groupby("turb_id")["patv"].ffill())
    np.testing.assert_allclose(value("_next_patv"), panel_pdf.groupby("turb_id")["patv"].bfill())


@pytest.mark.parametrize("width", [1, 2, 5, 24])
def test_trailing(panel, panel_pdf, width):
    stats = ["sum", "mean", "max", "min", "var", "var_pop", "skew", "kurt", "share"]
    got = collect(rolling.trailing(panel, {s: (s, "patv") for s in stats}, width), "turb_id", "time")
    r = panel_pdf.groupby("turb_id")["patv"].rolling(width)
    want = {
        "sum": r.sum(), "mean": r.mean(), "share": r.mean(), "max": r.max(), "min": r.min(), "var": r.var(),
        "var_pop": r.var(ddof=0), "skew": r.skew(), "kurt": r.kurt(),
    }
    flat = (r.max() == r.min()).to_numpy()
    for s in stats:
        expected = want[s].to_numpy()
        if s in ("skew", "kurt"):  # undefined on a flat window; pandas picks 0 and -3 there
            expected = np.where(flat, np.nan, expected)
        np.testing.assert_allclose(got[s].astype(float), expected, rtol=1e-6, atol=1e-6, err_msg=s)


def test_trailing_needs_a_full_window_without_gaps(spark):
    rows = [(1, i, None if i == 12 else float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "turb_id bigint, time bigint, x double")
    got = collect(rolling.trailing(df, {"m": ("mean", "x"), "n": ("count", "x")}, 5), "time")
    assert got["m"].isna().tolist() == [i < 4 or 12 <= i <= 16 for i in range(30)]
    assert got["n"].tolist()[14] == 4


@pytest.mark.parametrize("size", [6, 500])
def test_trailing_arrow(panel, panel_pdf, size):
    specs = {f"{s}_{w}": (s, "patv", w) for s in ("mean", "max", "min", "var", "median") for w in (3, 24)}
    got = collect(rolling.trailing_arrow(panel, specs, size=size), "turb_id", "time")
    for o, (s, _, w) in specs.items():
        want = getattr(panel_pdf.groupby("turb_id")["patv"].rolling(w), s)()
        np.testing.assert_allclose(got[o], want, rtol=1e-9, atol=1e-6)


def test_both_rolling_paths_agree(panel):
    a = collect(rolling.trailing(panel, {"x": ("var", "patv")}, 24), "turb_id", "time")
    b = collect(rolling.roll_bundle(panel, ["patv"], [24]), "turb_id", "time")
    np.testing.assert_allclose(a["x"].astype(float), b["win24_var_patv"], rtol=1e-9, atol=1e-6)
    assert [c for c in b.columns if c.startswith("win")] == [
        f"win24_{n}_patv" for n in ("mean", "amax", "amin", "var", "median")
    ]


def test_no_window_task_holds_a_whole_turbine(panel):
    """The big side is always partitioned by block; only block summaries are ordered per turbine."""
    df = rolling.trailing(panel, {"m": ("mean", "patv")}, 24)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition" in line]
    assert windows and all("_blk" in w for w in windows)


@pytest.mark.parametrize("size", [5, 100])
def test_interpolate(panel, panel_pdf, size):
    got = collect(gaps.interpolate(panel, "patv", size=size), "turb_id", "time")
    want = by_turbine(panel_pdf, lambda g: g["patv"].interpolate().bfill().ffill())
    np.testing.assert_allclose(got["patv"], want)


def test_interpolate_edges_of_six_rows(spark):
    rows = [(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, None), (1, 4, 8.0), (1, 5, None)]
    df = spark.createDataFrame(rows, "turb_id bigint, time bigint, x double")
    assert collect(gaps.interpolate(df, "x", size=2), "time")["x"].tolist() == [2, 2, 4, 6, 8, 8]
    open_ends = collect(gaps.interpolate(df, "x", size=2, edges=False), "time")["x"]
    assert open_ends.isna().tolist() == [True, False, False, False, False, True]


@pytest.mark.parametrize("size", [2, 3, 1000])
def test_fill_row_order_equals_global_fill(spark, size):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(f, s, t) for f in (1, 2) for s in range(0, 60, 3) for t in range(1, 8)], columns=["farm_id", "slot", "turb_id"])
    pdf["x"] = np.where(rng.random(len(pdf)) < 0.5, np.nan, rng.integers(0, 100, len(pdf)).astype(float))
    pdf.loc[pdf["slot"].between(9, 15) | (pdf["slot"] > 50), "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = collect(gaps.fill_row_order(df, ["x"], size=size), "farm_id", "slot", "turb_id")
    want = pdf.groupby("farm_id")["x"].transform(lambda s: s.bfill().ffill())
    np.testing.assert_allclose(got["x"], want)


def test_time_grid_and_missing_slots(spark):
    rows = [(1, 145, 10.0), (1, 147, 12.0), (2, 146, 9.0), (2, 300, 1.0)]
    df = spark.createDataFrame(rows, "turb_id bigint, slot bigint, patv double")
    grid = collect(gaps.time_grid(df, 144, size=50), "slot")
    assert grid["slot"].tolist() == list(range(145, 301))
    assert grid.loc[0, ["day", "tmstamp"]].tolist() == [2, "00:10"]
    full = collect(gaps.fill_missing_slots(df, 144, size=50), "turb_id", "slot")
    assert len(full) == 2 * 156 and full["patv"].notna().sum() == 4
    back = gaps.time_grid(df, 144).withColumn("again", gaps.slot_of(144))
    assert back.filter("again <> slot").count() == 0
