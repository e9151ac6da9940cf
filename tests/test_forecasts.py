"""Hierarchy, blending, metrics, models, and both legs end to end."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeolis.operators import blend, hierarchy, metrics, models, segments
from aeolis.plans import forecast as fc
from aeolis.plans.fixture import Fixture
from aeolis.plans.forecast_checks import SETTINGS, SMALL
from aeolis.session import stage

EDGES = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 4), ("all", 1), ("all", 2), ("all", 3), ("all", 4)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "group_id string, turb_id bigint")


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(9)
    names = ["t1", "t2", "t3", "t4", "a", "b", "all"]
    return spark.createDataFrame([(n, s, float(rng.normal(500, 100))) for n in names for s in range(3)], "node string, step bigint, yhat double").persist()


def test_reconcile_is_the_orthogonal_projection(edges, nodes):
    names = ["t1", "t2", "t3", "t4", "a", "b", "all"]
    a = np.zeros((3, 7))
    for g, t in EDGES:
        a[["a", "b", "all"].index(g), t - 1] = -1
    a[:, 4:] = np.eye(3)
    m = np.eye(7) - a.T @ np.linalg.inv(a @ a.T) @ a
    before = nodes.toPandas().pivot(index="node", columns="step", values="yhat").loc[names]
    out = hierarchy.reconcile(nodes, edges)
    after = out.toPandas().pivot(index="node", columns="step", values="yhat").loc[names]
    np.testing.assert_allclose(after, m @ before.to_numpy())
    residual = hierarchy.coherence_residual(out, edges).toPandas()
    assert np.abs(residual["residual"]).max() < 1e-9
    twice = hierarchy.reconcile(out, edges).toPandas().pivot(index="node", columns="step", values="yhat").loc[names]
    np.testing.assert_allclose(twice, after)


def test_reconcile_adds_up_where_forecasts_are_missing(spark, edges, nodes):
    """Step 0 lacks a turbine (as a row, and as NULL at step 1); step 2 lacks a group and all turbines of another."""
    gone = {(0, "t2"), (2, "b"), (2, "t1"), (2, "t2")}
    rows = [tuple(r) for r in nodes.collect() if (r["step"], r["node"]) not in gone]
    rows = [(n, s, None if (s, n) == (1, "t3") else y) for n, s, y in rows]
    frame = spark.createDataFrame(rows, "node string, step bigint, yhat double")
    out = {(r["step"], r["node"]): r["yhat"] for r in hierarchy.reconcile(frame, edges).collect()}
    before = {(s, n): y for n, s, y in rows}
    assert out.keys() == before.keys() and out[1, "t3"] is None
    assert out[2, "a"] == before[2, "a"]
    for s in range(3):
        there = [n for n in ["t1", "t2", "t3", "t4", "a", "b", "all"] if before.get((s, n)) is not None]
        of = {g: [f"t{t}" for h, t in EDGES if h == g and f"t{t}" in there] for g in ("a", "b", "all") if g in there}
        a = np.array([[(n == g) - float(n in of[g]) for n in there] for g in of if of[g]])
        m = np.eye(len(there)) - a.T @ np.linalg.inv(a @ a.T) @ a
        np.testing.assert_allclose([out[s, n] for n in there], m @ np.array([before[s, n] for n in there]))
        assert all(abs(out[s, g] - sum(out[s, n] for n in of[g])) < 1e-9 for g in of if of[g])


def test_rollup_and_mask(spark, edges):
    rows = spark.createDataFrame([(t, 0, float(t), int(t != 3)) for t in range(1, 5)], "turb_id bigint, slot bigint, patv double, mask int")
    power = {r["node"]: r["patv"] for r in hierarchy.rollup(rows, edges).collect()}
    assert power == {"t1": 1, "t2": 2, "t3": 3, "t4": 4, "a": 3, "b": 9, "all": 10}
    mask = {r["node"]: r["mask"] for r in hierarchy.rollup_mask(rows, edges).collect()}
    assert (mask["a"], mask["b"], mask["all"], mask["t3"]) == (1, 0, 0, 0)
    assert [r["group_id"] for r in hierarchy.group_order(edges).collect()] == ["a", "b", "all"]


def _preds(spark, n_models=2, n_turb=2, steps=8):
    rows = [(m, t, s, float(10 * m + t + s)) for m, t, s in itertools.product(range(1, n_models + 1), range(1, n_turb + 1), range(steps))]
    return spark.createDataFrame(rows, "model_id bigint, turb_id bigint, step bigint, yhat double")


def test_segments_partition_the_horizon(spark):
    lengths = spark.createDataFrame([(1, 3), (2, 3), (3, 8), (4, 5)], "model_id bigint, output_len bigint")
    seg = {r["model_id"]: (r["seg_start"], r["seg_end"]) for r in blend.horizon_segments(lengths).collect()}
    assert seg == {1: (0, 3), 2: (0, 3), 3: (5, 8), 4: (3, 5)}
    out = blend.segment_concat(_preds(spark, 4), blend.horizon_segments(lengths)).filter("turb_id = 1").orderBy("step").collect()
    assert [r["step"] for r in out] == list(range(8))
    assert [r["yhat"] for r in out] == [16, 17, 18, 44, 45, 36, 37, 38]


def test_blend_of_equal_legs_is_identity(spark):
    leg = _preds(spark, 1).drop("model_id")
    out = blend.blend_legs(leg, leg, 4)
    assert out.exceptAll(leg.select(out.columns)).count() == 0


def test_anchor_adjust(spark):
    leg = _preds(spark, 1).drop("model_id")
    history = spark.createDataFrame([(1, 0, 100.0), (1, 1, None), (1, 2, 50.0), (2, 0, 70.0), (2, 1, None)], "turb_id bigint, slot bigint, patv double")
    out = {(r["turb_id"], r["step"]): r["yhat"] for r in blend.anchor_adjust(leg, history, 4, 1).collect()}
    assert out[(1, 0)] == 50.0 and out[(1, 2)] == pytest.approx(13 + (50 - 13) * 0.25) and out[(1, 4)] == 15
    assert out[(2, 0)] == 12.0  # nothing reported within the look-back: no correction


def test_residual_decay_by_hand(spark):
    rows = [(1, i, float(100 + i), float(50 + i), i in (6, 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "turb_id bigint, time bigint, target double, pred_target double, abnormal boolean")
    out = [r["pred_target"] for r in blend.residual_decay_adjust(df, 8, 4, 6).orderBy("time").collect()]
    assert out[:8] == [50.0 + i for i in range(8)]
    assert out[8] == pytest.approx(54.5 + 50) and out[11] == pytest.approx(54.5 + 50 * 0.25) and out[15] == pytest.approx(54.5)
    added = [r["pred_target"] for r in blend.residual_decay_adjust(df, 8, 4, 6, additive=True).orderBy("time").collect()]
    assert added[8] == pytest.approx(58 + 50)
    strict = blend.residual_decay_adjust(df, 8, 4, 6, max_abnormal=0.5).orderBy("time").collect()
    assert strict[8]["pred_target"] == 58.0  # half of the look-back is abnormal: left alone


def test_jitter_is_small_centred_and_repeatable(spark):
    leg = _preds(spark, 1, 20, 100).drop("model_id")
    once, again = (blend.add_jitter(df).orderBy("turb_id", "step").toPandas() for df in (leg, leg.repartition(7)))
    pd.testing.assert_frame_equal(once[again.columns], again)
    noise = once["yhat"] - leg.orderBy("turb_id", "step").toPandas()["yhat"]
    assert abs(noise.mean()) < 0.002 and 0.013 < noise.std() < 0.017
    assert blend.add_jitter(leg, only_if_flat=0.01).exceptAll(leg.select("turb_id", "step", "yhat")).count() == 0


@pytest.mark.parametrize("stride", [1, 3])
def test_sliding_score_by_hand(spark, stride):
    rng = np.random.default_rng(4)
    n, h = 40, 8
    y, p = rng.uniform(0, 1500, (2, 3, n))
    bad = rng.random((3, n)) < 0.3
    bad[1, 5:20] = True  # windows of turbine 2 without any normal row
    rows = [(t + 1, i, float(y[t, i]), float(p[t, i]), bool(bad[t, i])) for t in range(3) for i in range(n)]
    df = spark.createDataFrame(rows, "turb_id bigint, time bigint, y double, yhat double, abnormal boolean")
    maes, rmses = [], []
    for i in range(0, n - h + 1, stride):
        m = r = 0.0
        for t in range(3):
            ok = ~bad[t, i : i + h]
            if ok.any():
                e = (p[t, i : i + h] - y[t, i : i + h])[ok] / 1000
                m, r = m + np.abs(e).mean(), r + np.sqrt((e**2).mean())
        maes.append(m)
        rmses.append(r)
    got = metrics.score_sliding(df, h, stride).collect()[0]
    assert got["mae"] == pytest.approx(np.mean(maes)) and got["rmse"] == pytest.approx(np.mean(rmses))
    assert got["score"] == pytest.approx((np.mean(maes) + np.mean(rmses)) / 2)


def test_scores_of_an_empty_mask(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 1.0, 0), (1, 1, 5.0, 2.0, 0)], "turb_id bigint, step bigint, y double, yhat double, mask int")
    assert tuple(metrics.score_masked_len(df).collect()[0]) == (0, 0, 0)
    assert tuple(metrics.score_fixed_len(df, 288).collect()[0]) == (0, 0, 0)
    assert df.agg(metrics.loss_masked_mean()).collect()[0][0] == 0


def test_tree_table_default_direction(spark):
    rows = [
        (1, 0, 0, "x", 5.0, False, 1, 2, None), (1, 0, 1, None, None, None, None, None, 1.0),
        (1, 0, 2, None, None, None, None, None, 2.0), (1, 1, 0, None, None, None, None, None, 10.0),
    ]
    from aeolis.plans.model_checks import TREE_SCHEMA

    nodes = spark.createDataFrame(rows, TREE_SCHEMA)
    df = spark.createDataFrame([(1, 5.0), (2, 5.1), (3, None)], "id bigint, x double")
    assert {r["id"]: r["score"] for r in models.score_tree_table(df, nodes, ["id"]).collect()} == {1: 11, 2: 12, 3: 12}


def test_grid_sizes(spark):
    sizes = models.grid_rows(spark, {"main": models.GRID_MAIN, "temperature": models.GRID_TEMPERATURE}, 288).groupBy("grid").count()
    assert {r[0]: r[1] for r in sizes.collect()} == {"main": 240, "temperature": 48}
    assert len(models.ensemble_grid()) == 10


def test_missing_shared_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from aeolis.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://somewhere:7077")))


@pytest.fixture(scope="module")
def data(spark):
    d = Fixture(spark, "/root/testdata/sf0.01")
    d.__dict__["panel"] = stage(d.panel, "panel")
    return d


def test_long_leg_beats_the_last_value(data):
    features = stage(fc.long_leg_features(data.panel, data.curve, data.angle, SETTINGS, SMALL), "labelled")
    counts = {r[0]: r[1] for r in features.groupBy("data_type").count().collect()}
    assert counts["pred"] == 5 * SETTINGS.horizon and set(counts) == {"train", "valid", "test", "pred"}
    leg = fc.fit_long_leg(features, SMALL)
    assert len(leg.features) == 15 + 40 + 1 + 47  # fewer Fourier coefficients fit a 96-step window
    scores = {r["data_type"]: r["score"] for r in fc.evaluate_long_leg(leg, features, SETTINGS).collect()}
    last = metrics.score_sliding(data.evaluated, SETTINGS.horizon).collect()[0]["score"]
    assert max(scores.values()) < last
    out = fc.forecast_long_leg(leg, features, SETTINGS).toPandas()
    assert sorted(out["step"].unique()) == list(range(SETTINGS.horizon)) and out["yhat"].notna().all()


def test_turbines_with_gaps_get_all_steps(data):
    """One turbine stopped more than a horizon ago, one lacks slots of the last horizon."""
    turbines, last = sorted(r[0] for r in data.panel.select("turb_id").distinct().collect()), data.panel.agg(F.max("slot")).first()[0]
    stopped = (F.col("turb_id") == turbines[0]) & (F.col("slot") > last - 2 * SETTINGS.horizon)
    holes = (F.col("turb_id") == turbines[1]) & F.col("slot").isin([last, last - 3, last - 4])
    panel = stage(data.panel.filter(~stopped & ~holes), "panel-gaps")
    features = stage(fc.long_leg_features(panel, data.curve, data.angle, SETTINGS, SMALL), "labelled-gaps")
    out = fc.forecast_long_leg(fc.fit_long_leg(features, SMALL), features, SETTINGS)
    rows = out.filter("yhat IS NOT NULL").collect()
    assert sorted((r["turb_id"], r["step"]) for r in rows) == [(t, s) for t in turbines for s in range(SETTINGS.horizon)]


def test_blend_without_the_other_leg(spark):
    short = spark.createDataFrame([(1, 0, 1.0), (1, 5, 2.0), (2, 5, 3.0)], "turb_id bigint, step bigint, yhat double")
    long = spark.createDataFrame([(1, 5, 4.0), (2, 5, None)], "turb_id bigint, step bigint, yhat double")
    for other, want in ((long, {(1, 0): 1.0, (1, 5): 3.0, (2, 5): 3.0}), (long.filter("turb_id = 2"), {(1, 0): 1.0, (1, 5): 2.0, (2, 5): 3.0})):
        assert {(r["turb_id"], r["step"]): r["yhat"] for r in blend.blend_legs(short, other, 4).collect()} == want


def test_blend_keeps_steps_of_one_leg(spark):
    short = spark.createDataFrame([(1, 0, 1.0), (1, 6, 2.0)], "turb_id bigint, step bigint, yhat double").withColumn("model_id", F.lit(3))
    long = spark.createDataFrame([(1, 1, 9.0), (1, 6, 4.0), (1, 7, 5.0)], "turb_id bigint, step bigint, yhat double").withColumn("model_id", F.lit(3))
    got = blend.blend_legs(short, long.unionByName(long.withColumn("model_id", F.lit(4))), 4, ("model_id",))
    assert {(r["model_id"], r["step"]): r["yhat"] for r in got.collect()} == {(3, 0): 1.0, (3, 1): 9.0, (3, 6): 3.0, (3, 7): 5.0, (4, 1): 9.0, (4, 6): 4.0, (4, 7): 5.0}


def test_jitter_of_flat_models_alone(spark):
    rows = [(m, t, s, 5.0 if m == 1 else float(10 * t + s)) for m in (1, 2) for t in (1, 2) for s in range(4)]
    df = spark.createDataFrame(rows, "model_id bigint, turb_id bigint, step bigint, yhat double")
    out = blend.add_jitter(df, only_if_flat=0.01, by=("model_id",))
    assert out.columns == df.columns
    moved = {(r["model_id"], r["turb_id"], r["step"]) for r in out.exceptAll(df).collect()}
    assert moved == {(1, t, s) for t in (1, 2) for s in range(4)}


def test_conjugate_gradients_equal_a_dense_solve():
    rng = np.random.default_rng(2)
    on = rng.random((40, 90)) < 0.2
    on[0], on[1] = True, on[2]
    group, turbine = np.nonzero(on)
    right = rng.normal(size=(7, 40)) * 100
    right[3], right[4, 5] = 0, np.nan
    got = hierarchy.conjugate_gradients(group, turbine, 90, right)
    want = np.linalg.solve(on.astype(float) @ on.T + np.eye(40), right.T).T
    assert np.isnan(got[4]).all() and np.allclose(np.delete(got, 4, 0), np.delete(want, 4, 0), rtol=1e-9, atol=1e-9)


def test_short_leg(data):
    rows = fc.short_leg_rows(data.panel, data.curve, data.angle, SETTINGS)
    assert rows.count() == 5 * 720
    assert rows.filter("patv IS NULL OR wspd IS NULL OR w_angle_sin IS NULL").count() == 0
    out = fc.forecast_short_leg(data.panel, rows, SETTINGS, 48, ((0, 6), (6, 12), (12, 24)), fade=10).toPandas()
    assert len(out) == 5 * 24 and out["yhat"].between(0, 3000).all()


def _panel_of_two(spark):
    rng = np.random.default_rng(6)
    rows = [(t, s, None if rng.random() < 0.2 else float(100 * t + 10 * (s % 24) + rng.normal()), None if t == 2 else float(rng.random()), s // 24 + 1) for t in (1, 2) for s in range(200)]
    return rows, spark.createDataFrame(rows, "turb_id long, slot long, patv double, wspd double, day long")


@pytest.mark.parametrize("size", [4096, 50])
def test_segment_samples(spark, size):
    rows, df = _panel_of_two(spark)
    got = {(r["turb_id"], r["anchor"]): r for r in segments.segment_samples(df, (5, 30), ((0, 3), (3, 10)), 24, ("day",), size=size).collect()}
    assert sorted(got) == [(t, s) for t in (1, 2) for s in range(4, 200)]
    x = {(t, s): (p, w) for t, s, p, w, _ in rows}
    mean = lambda v: pytest.approx(sum(v) / len(v)) if v else None
    for (t, s), r in got.items():
        assert r["day"] == s // 24 + 1
        for n in (5, 30):
            past = [x[t, i][0] for i in range(s - n + 1, s + 1)] if s >= n - 1 else []
            some = [v for v in past if v is not None]
            assert (r[f"last_patv_{n}"], r[f"mean_patv_{n}"]) == (some[-1] if some else None, mean(some))
            assert r[f"known_share_{n}"] == (pytest.approx(len(some) / n) if past else None)
            assert r[f"mean_wspd_{n}"] == (mean([x[t, i][1] for i in range(s - n + 1, s + 1)]) if past and t == 1 else None)
        for a, e in ((0, 3), (3, 10)):
            ahead = [x[t, i][0] for i in range(s + a + 1, s + e + 1)] if s + e < 200 else []
            assert r[f"y_{a}_{e}"] == mean([v for v in ahead if v is not None])


def test_models_from_cross_products(spark):
    """All models of a grid from one job, equal to least squares on the rows; every sample gets a forecast."""
    _, df = _panel_of_two(spark)
    samples = segments.segment_samples(df.withColumn("wspd", F.coalesce("wspd", F.lit(0.5))), (5, 30), ((0, 3), (3, 10)), 24, ("day",)).persist()
    grid = [{"days": n, "hidden1": h, "hidden2": 8, "output_len": e, "partial_days": d, "attention": c} for n in (5, 30) for h in (64, 128) for e in (3, 10) for d in (None, 6) for c in (True, False)]
    fitted = segments.train_grid_models(samples, grid, 1, {3: (0, 3), 10: (3, 10)})
    pdf = samples.toPandas()
    for g, m in zip(grid, fitted, strict=True):
        use = segments.inputs_of(g["days"])
        part = pdf.dropna(subset=[*use, segments.label_of(m.part.segment)])
        part = part if g["partial_days"] is None else part[part["day"] <= 6]
        use = use if g["attention"] else use[:4]
        x, y = part[use].to_numpy(), part[segments.label_of(m.part.segment)].to_numpy()
        sd = x.std(axis=0)
        live = sd > 1e-9
        z = np.where(live, (x - x.mean(axis=0)) / np.where(live, sd, 1), 0)
        w = np.linalg.solve(z.T @ z / len(z) + 64 / (g["hidden1"] * 8) * np.eye(len(use)), z.T @ (y - y.mean()) / len(z)) / np.where(live, sd, 1)
        assert m.samples == len(part) and list(m.weights.values()) == pytest.approx(w.tolist(), rel=1e-5, abs=1e-6)
    unknown = segments.segment_samples(df, (5,), (), 24)
    got = segments.score_segment_models(unknown, fitted[:4], ["turb_id", "anchor"])
    assert got.count() == 4 * 2 * 196 and got.filter("yhat IS NULL").count() == 0


def test_models_without_samples_or_spread(spark):
    flat = spark.createDataFrame([(1, s, 3.0, 1.0) for s in range(20)], "turb_id long, slot long, patv double, wspd double")
    for df, want in ((flat, 3.0), (flat.limit(0), 0.0)):
        [m] = segments.train_segment_models(segments.segment_samples(df, (4,), ((0, 2),), 24), [(0, 2)], 4, (0.0,))
        assert m.intercept + sum(w * m.means[c] for c, w in m.weights.items()) == pytest.approx(want)


def test_tree_table_of_many_nodes(spark):
    """A chain of 600 splits and 300 trees: far beyond what nested expressions would bear."""
    nodes = []
    for tree in range(300):
        for i in range(600):
            nodes += [(1, tree, 2 * i, "x", float(i), True, 2 * i + 1, 2 * i + 2, None), (1, tree, 2 * i + 1, None, None, None, None, None, float(i))]
        nodes.append((1, tree, 1200, None, None, None, None, None, 600.0))
    schema = "model_id bigint, tree_id bigint, node_id bigint, feature string, threshold double, default_left boolean, left_id bigint, right_id bigint, leaf_value double"
    df = spark.createDataFrame([(1, 2.5), (2, None), (3, 1e6)], "id long, x double")
    got = {r["id"]: r["score"] for r in models.score_tree_table(df, spark.createDataFrame(nodes, schema), ["id"]).collect()}
    assert got == {1: 900.0, 2: 0.0, 3: 180000.0}


def test_scaled_reconciliation(spark, edges, nodes):
    """M(std * y + u) - u, over std, equals reconciling the unscaled forecasts."""
    scaled = nodes.withColumn("u", F.length("node") * 2.0).withColumn("sd", F.length("node") + 0.5)
    small = scaled.withColumn("yhat", (F.col("yhat") - F.col("u")) / F.col("sd"))
    back = hierarchy.reconcile(small, edges, u="u", std="sd").select("node", "step", (F.col("yhat") * F.col("sd") + F.col("u")).alias("back"))
    both = hierarchy.reconcile(nodes, edges).join(back, ["node", "step"]).collect()
    assert both and all(abs(r["yhat"] - r["back"]) < 1e-9 for r in both)
