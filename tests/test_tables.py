"""Masks, farm statistics, repair, splits, scaling, sources."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeolis.functions import scalar as sc
from aeolis.operators import farm, repair, split_scale
from aeolis.sources import panel as src

SENSORS = "turb_id bigint, slot bigint, wspd double, wdir double, ndir double, pab1 double, pab2 double, pab3 double, patv double"


def test_missing_values_never_raise_a_mask(spark):
    rows = [
        (1, 0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0),
        (1, 1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (1, 2, None, None, None, None, None, None, None),
        (1, 3, 5.0, 181.0, 0.0, 0.0, 0.0, 0.0, 9.0),
        (1, 4, 5.0, 180.0, -720.0, 89.0, 0.0, 0.0, 9.0),
        (1, 5, None, 0.0, 0.0, 0.0, 0.0, None, -1.0),
    ]
    df = spark.createDataFrame(rows, SENSORS)
    got = df.select(sc.abnormal_patv().alias("a"), sc.abnormal_eval().alias("e"), sc.unknown_patv().alias("u")).collect()
    assert [r["a"] for r in got] == [True, False, False, True, False, False]
    assert [r["e"] for r in got] == [True, False, False, True, False, True]
    assert [r["u"] for r in got] == [True, True, True, True, False, True]


def test_power_curve_guards(spark):
    df = spark.createDataFrame([(1, 10.0), (2, -2.0), (3, None), (4, 1.0)], "turb_id bigint, wspd double")
    curve = spark.createDataFrame([(1, 19.0, 2.0, 0.0, 1500.0), (2, 19.0, 1.5, 0.0, 1500.0), (3, 19.0, 2.0, 0.0, 1500.0)], "turb_id bigint, a double, beta double, b double, mx double")
    got = {r["turb_id"]: r["max_patv"] for r in sc.with_curve(df, curve).collect()}
    assert got == {1: 1500.0, 2: None, 3: None, 4: None}
    assert sc.with_curve(df, curve, "inner").count() == 3


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a__qh_1.0` int, `b<c>` int")
    assert sc.clean_names(df).columns == ["a__qh_10", "bc"]


def test_group_percentiles_of_odd_groups(spark):
    """NULL keys, groups without a known value, one value, clashing names; no table at all."""
    rows = [(None, 1.0), (None, 4.0), (1, None), (2, 7.0), (2, None), (3, -0.0), (3, 0.0)]
    df = spark.createDataFrame(rows, "slot bigint, x double").withColumn("_v", F.lit(9)).withColumn("_k", F.lit(9))
    got = farm.group_percentiles(df, ["slot"], {"m": ("x", 0.5), "p": ("x", 0.25)}, {"n": F.count("x")})
    assert got.columns == ["slot", "n", "m", "p"]
    assert {r["slot"]: (r["n"], r["m"], r["p"]) for r in got.collect()} == {None: (2, 2.5, 1.75), 1: (0, None, None), 2: (1, 7.0, 7.0), 3: (2, 0.0, 0.0)}
    assert farm.group_percentiles(df.limit(0), ["slot"], {"m": ("x", 0.5)}).count() == 0


@pytest.mark.parametrize("few", [65_536, 60, 5])
def test_group_percentiles_of_hot_groups(spark, few):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"slot": np.repeat([1, 2, 3], [4000, 50, 1]), "x": np.round(rng.normal(0, 5, 4051), 1)})
    pdf.loc[rng.random(len(pdf)) < 0.1, "x"] = np.nan
    pdf.loc[pdf["slot"] == 3, "x"] = 2.5
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    wanted = {"lo": ("x", 0.15), "mid": ("x", 0.5), "hi": ("x", 0.85), "top": ("x", 1.0)}
    got = farm.group_percentiles(df, ["slot"], wanted, {"n": F.count("x")}, few=few).toPandas().set_index("slot")
    for slot, g in pdf.groupby("slot"):
        x = g["x"].dropna()
        want = np.percentile(x, [15, 50, 85, 100])
        np.testing.assert_allclose(got.loc[slot, ["lo", "mid", "hi", "top"]].astype(float), want)
        assert got.loc[slot, "n"] == len(x)


def test_backward_fill_of_farm_series(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 3, 2.0), (1, 4, None), (2, 1, 5.0)], "farm_id int, slot bigint, m double")
    got = {(r[0], r[1]): r[2] for r in farm.fill_along_time(df, ["m"]).select("farm_id", "slot", "m").collect()}
    assert got == {(1, 0): 2.0, (1, 3): 2.0, (1, 4): None, (2, 1): 5.0}
    both = farm.fill_along_time(df, ["m"], forward=True)
    assert {r["m"] for r in both.filter("farm_id = 1").collect()} == {2.0}


def test_pool_and_resampling(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"turb_id": np.repeat([1, 2], 300), "slot": list(range(300)) * 2})
    pdf["wspd"] = np.round(rng.uniform(0, 12, 600), 2)
    pdf["mask"] = (rng.random(600) < 0.7).astype(int)
    pdf["patv"] = np.where(pdf["mask"] == 1, np.round(rng.uniform(1, 1500, 600), 2), np.nan)
    df = spark.createDataFrame(pdf).withColumn("patv", F.when(~F.isnan("patv"), F.col("patv")))
    pool = repair.normal_pool(df, size=16).toPandas()
    for bucket, g in pool.groupby("ws_bucket"):
        assert sorted(g["rn"]) == list(range(len(g)))
        assert 0 <= bucket <= 10
    assert len(pool) == (pdf["mask"] == 1).sum()
    once = repair.resample_noisy(df, repair.normal_pool(df), seed=4).orderBy("turb_id", "slot").toPandas()
    again = repair.resample_noisy(df.repartition(5), repair.normal_pool(df), seed=4).orderBy("turb_id", "slot").toPandas()
    pd.testing.assert_frame_equal(once[again.columns], again)
    assert once["patv"].notna().all() and len(once) == 600
    by_bucket = pool.groupby("ws_bucket")["patv"].apply(set)
    for r in once[once["mask"] == 0].itertuples():
        assert r.patv in by_bucket[r.ws_bucket]


def test_split_by_day_cutoffs(spark):
    df = spark.createDataFrame([(1, d, None if d > 38 else float(d)) for d in range(1, 41)], "turb_id bigint, day bigint, target double")
    got = {r["day"]: r["data_type"] for r in split_scale.split_by_day(df, 15, 15).collect()}
    assert [d for d, t in got.items() if t == "train"] == list(range(1, 9))
    assert [d for d, t in got.items() if t == "valid"] == list(range(9, 24))
    assert [d for d, t in got.items() if t == "test"] == list(range(24, 39))
    assert [d for d, t in got.items() if t == "pred"] == [39, 40]
    online = split_scale.split_by_day(df, 15, 15, online=True).groupBy("data_type").count().collect()
    assert {r[0]: r[1] for r in online} == {"train": 38, "pred": 2}


@pytest.mark.parametrize("mode,want", [("train", {"train": 80, "val": 30}), ("val", {"train": 70, "val": 30, "test": 20}),
                                       ("test", {"test": 20}), ("finetune", {"finetune": 100}), ("submit", {"submit": 10})])
def test_split_by_steps_modes(spark, mode, want):
    df = spark.range(100).select(F.col("id").alias("slot"))
    rows = split_scale.split_by_steps(df, 10, 20, 10, mode)
    assert {r[0]: r[1] for r in rows.groupBy("split").count().collect()} == want


def test_scaling_round_trip(panel):
    feats = ["patv", "slot"]
    rows = panel.withColumn("slot", F.col("slot").cast("double")).withColumn("flat", F.lit(4.0))
    scaler = split_scale.scaler_fit(rows, [*feats, "flat"])
    scaled = split_scale.standardize(rows, scaler, [*feats, "flat"])
    assert scaled.filter("flat IS NOT NULL").count() == 0
    back = split_scale.inverse_standardize(scaled, scaler, {f: f for f in feats}).toPandas()
    want = rows.toPandas()
    for f in feats:
        a = back.sort_values(["turb_id", "time"])[f].to_numpy()
        np.testing.assert_allclose(a, want.sort_values(["turb_id", "time"])[f].to_numpy(), atol=1e-6)
    assert split_scale.scalable(["a", "sin_tm", "w_angle_cos", "mask_mean"]) == ["a"]


@pytest.mark.parametrize("size", [8, 4096])
def test_sample_count_and_content(spark, size):
    df = spark.range(50).select(F.lit(1).alias("turb_id"), F.col("id").alias("slot"), F.when(F.col("id") != 20, F.col("id").cast("double")).alias("x"))
    got = split_scale.sequence_samples(df, 12, 5, ["x"], ["x"], size=size).orderBy("anchor").collect()
    assert len(got) == 50 - 12 - 5 + 1
    first = got[9]
    assert first["anchor"] == 20 and first["enc_x"] == [float(i) for i in range(9, 20)] + [None]
    assert first["dec_x"] == [21.0, 22.0, 23.0, 24.0, 25.0]
    assert split_scale.sequence_samples(df, 12, 0, ["x"], [], size=size).count() == 39


def test_read_panel_csv(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text(
        "TurbID,Day,Tmstamp,Wspd,Wdir,Etmp,Itmp,Ndir,Pab1,Pab2,Pab3,Prtv,Patv\n"
        "1,1,00:00,,,,,,,,,,\n1,1,00:10,6.17,-3.99,30.73,41.8,25.92,1,1,1,-0.25,494.66\n1,9,00:20,NaN,0,0,0,0,0,0,0,0,NaN\n"
    )
    df = src.read_panel(spark, str(path))
    assert df.columns[:4] == ["turb_id", "day", "tmstamp", "wspd"]
    rows = df.orderBy("date").collect()
    assert rows[0]["patv"] is None and rows[1]["patv"] == 494.66 and rows[2]["wspd"] is None
    assert src.read_panel(spark, str(path), partial_days=8).count() == 2
    curve = tmp_path / "curve.csv"
    curve.write_text("TurbID,a,beta,b,mx,cp\n1,19.0,1.9,0.001,1550,9.6\n")
    assert src.read_curve(spark, str(curve)).collect()[0]["mx"] == 1550
    angle = tmp_path / "angle.csv"
    angle.write_text("diff_angle,TurbID\n-35,1\n")
    assert src.read_angle(spark, str(angle)).collect()[0].asDict() == {"diff_angle": -35.0, "turb_id": 1}


def test_dimensions_are_checked_before_they_are_joined(spark, tmp_path):
    def curve(*lines):
        path = tmp_path / f"curve-{len(list(tmp_path.iterdir()))}.csv"
        path.write_text("beta,TurbID,a,b,mx\n" + "\n".join(lines))
        return str(path)

    turbines = spark.createDataFrame([(1,), (2,), (2,)], "turb_id bigint")
    whole = curve("1.9,1,19.0,0.001,1550", "1.8,2,20.0,0.001,1560")
    assert sorted(r["beta"] for r in src.read_curve(spark, whole, turbines).collect()) == [1.8, 1.9]
    for lines, said in (
        (["1.9,1,19.0,0.001,1550", "1.8,1,20.0,0.001,1560"], "1 rows repeat a turb_id"),
        (["1.9,1,19.0,0.001,1550"], "1 turbines have no row"),
        (["1.9,1,19.0,0.001,", "1.8,2,20.0,0.001,1560"], "1 rows lack"),
        (["1.9,,19.0,0.001,1"], "1 rows lack"),
    ):
        with pytest.raises(ValueError, match=said):
            src.read_curve(spark, curve(*lines), turbines)


def test_day_filter_reaches_the_scan_and_splits_are_pruned(spark, tmp_path):
    spark.createDataFrame([(1, 1, 2.0), (1, 20, 3.0)], "TurbID bigint, Day bigint, Patv double").write.parquet(str(tmp_path / "p"))
    plan = src.read_panel(spark, str(tmp_path / "p"), "parquet", 14).select("turb_id", "patv")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(Day,14)" in text and "Wspd" not in text.split("ReadSchema")[1].split(">")[0]
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "x bigint, data_type string")
    src.write_features(rows, str(tmp_path / "f"))
    part = src.read_split(spark, str(tmp_path / "f"), "test")
    assert "PartitionFilters: [isnotnull(data_type" in part._jdf.queryExecution().executedPlan().toString()
    assert part.collect()[0]["x"] == 2


def test_recent_tail(panel):
    got = src.recent_tail(panel, 10, pos="time")
    assert {r[0]: r[1] for r in got.groupBy("turb_id").count().collect()} == {1: 10, 2: 10, 3: 10}
