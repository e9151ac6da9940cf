"""Histogram boosting against a plain loop over all rows, and by hand."""

import math

import numpy as np
import pytest

from aeolis.operators import boosting, models
from aeolis.operators.boosting import BoostSettings, fit
from aeolis.sources import panel as src

ALL = dict(row_share=1.0, col_share=1.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        a, b, t = float(rng.integers(0, 12)), float(rng.integers(0, 9)), float(rng.integers(1, 6))
        y = 3 * a + (20 if t in (2, 5) else 0) + (15 if b > 4 else 0) + float(rng.normal())
        rows.append((i, None if i % 7 == 0 else a, b, t, None if i == 5 else y, i % 4 == 0))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, t double, y double, held boolean").persist()


def plain(rows, cols, cats, s):
    """Leaf-wise boosting row by row, with every distinct value a border; returns predictions of all rows by round."""
    x = [[r[1 + c] for c in range(3)] for r in rows]
    train = [i for i, r in enumerate(rows) if r[4] is not None and not r[5]]
    base = sum(rows[i][4] for i in train) / len(train)
    score, out = [base] * len(rows), []
    soft = lambda g: math.copysign(max(abs(g) - s.l1, 0), g)
    gain_of = lambda g, n: soft(g) ** 2 / (n + s.l2)

    def options(mine):
        g = {i: score[i] - rows[i][4] for i in mine}
        every, best = sum(g.values()), None
        for c in cols:
            values = sorted({x[i][c] for i in mine if x[i][c] is not None})
            if c in cats:
                mean = lambda v: sum(g[i] for i in mine if x[i][c] == v) / (sum(x[i][c] == v for i in mine) + boosting.SMOOTH)
                values = sorted(values, key=lambda v: (mean(v), v))
            for at in range(len(values) - 1):
                left = set(values[: at + 1])
                for default in (False, True):
                    inside = [i for i in mine if (default if x[i][c] is None else x[i][c] in left)]
                    lg, ln = sum(g[i] for i in inside), len(inside)
                    if ln >= s.min_rows and len(mine) - ln >= s.min_rows:
                        gain = gain_of(lg, ln) + gain_of(every - lg, len(mine) - ln) - gain_of(every, len(mine))
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-6):
                            best = (gain, c, left, default)
        return best

    for _ in range(s.rounds):
        leaves = [(train, list(range(len(rows))))]
        while len(leaves) < s.leaves:
            found = [(options(mine), k) for k, (mine, _) in enumerate(leaves)]
            found = [(f, k) for f, k in found if f]
            if not found:
                break
            (_, c, left, default), k = max(found, key=lambda f: f[0][0])
            border = None if c in cats else max(left)
            goes = lambda i: default if x[i][c] is None else x[i][c] in left if border is None else x[i][c] <= border
            mine, reach = leaves.pop(k)
            leaves += [([i for i in mine if goes(i)], [i for i in reach if goes(i)]), ([i for i in mine if not goes(i)], [i for i in reach if not goes(i)])]
        for mine, reach in leaves:
            v = -s.rate * soft(sum(score[i] - rows[i][4] for i in mine)) / (len(mine) + s.l2)
            for i in reach:
                score[i] += v
        out.append(list(score))
    return out


@pytest.mark.parametrize("cats", [(), ("t",)])
def test_trees_equal_a_plain_loop(table, cats):
    rows, df = table
    s = BoostSettings(rounds=3, rate=0.5, leaves=3, min_rows=10, **ALL)
    borders = {"a": [float(v) for v in range(11)], "b": [float(v) for v in range(8)]} | ({} if cats else {"t": [1.0, 2.0, 3.0, 4.0]})
    model = fit(df, ["a", "b", "t"], "y", "held", cats, s, borders)
    want = plain(rows, (0, 1, 2), (2,) if cats else (), s)
    got = {r["id"]: r["pred_target"] for r in models.predict(model, df).collect()}
    rounds = next(h[1] for h in model.history if h[4])
    assert rounds == 3 and all(abs(got[i] - want[-1][i]) < 1e-5 for i in range(len(rows)))
    for h in model.history[1:]:
        for error, side in ((h[2], False), (h[3], True)):
            of = [(want[h[1] - 1][i] - r[4]) ** 2 for i, r in enumerate(rows) if r[4] is not None and r[5] is side]
            assert error == pytest.approx(math.sqrt(sum(of) / len(of)), abs=1e-6)


def test_training_stops_after_ten_rounds_without_gain(spark):
    """Noise alone: the first rounds are the best ones, and later trees are dropped."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(y), bool(h)) for a, y, h in zip(rng.normal(size=400), rng.normal(size=400), rng.random(400) < 0.5, strict=True)], "a double, y double, held boolean")
    model = fit(df, ["a"], "y", "held", settings=BoostSettings(rounds=200, rate=0.3, leaves=8, min_rows=5, bins=32, **ALL))
    errors = [h[3] for h in model.history]
    best = min(range(len(errors)), key=lambda k: errors[k])
    assert len(errors) == best + 11 and [h[4] for h in model.history].index(True) == best
    assert len({r[1] for r in model.rows}) == best + 1  # the mean and one tree a round


def test_model_survives_its_files(spark, table, tmp_path):
    _, df = table
    model = fit(df, ["a", "b", "t"], "y", "held", ["t"], BoostSettings(rounds=6, rate=0.3, leaves=5, bins=16))
    src.save_model(model, spark, str(tmp_path))
    again = src.load_model(spark, str(tmp_path))
    both = models.predict(again, models.predict(model, df, "one"), "two").collect()
    assert all(r["one"] == r["two"] for r in both)
    stored = models.score_tree_table(df, src.load_nodes(spark, str(tmp_path)), ["id"]).collect()
    assert {r["id"]: r["score"] for r in stored} == {r["id"]: r["one"] for r in both}
    assert [h[1] for h in again.history] == list(range(len(again.history))) and again.errors(spark).count() == 7
    ranked = models.feature_importance(model, spark).collect()
    gains = {}
    for r in model.rows:
        if r[3]:
            gains[r[3]] = gains.get(r[3], 0) + r[10]
    assert [r["feature"] for r in ranked] == sorted(gains, key=gains.get, reverse=True) and sum(r["importance"] for r in ranked) == pytest.approx(1)
    # Rows drawn by hash: the same model again, however the rows are dealt.
    same = fit(df.repartition(5), ["a", "b", "t"], "y", "held", ["t"], BoostSettings(rounds=6, rate=0.3, leaves=5, bins=16))
    assert [r[:8] for r in same.rows] == [r[:8] for r in model.rows]


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "a double, y double")
    assert models.predict(fit(none, ["a"], "y"), none).count() == 0
    flat = spark.createDataFrame([(None, 2.0), (1.0, 2.0), (1.0, None)], "a double, y double")
    model = fit(flat, ["a"], "y", settings=BoostSettings(rounds=2, min_rows=1, **ALL))
    assert [r["pred_target"] for r in models.predict(model, flat).collect()] == [2.0, 2.0, 2.0]


def test_large_ensembles_are_scored_in_parts(spark):
    nodes = [(m, 0, 0, "x", 1.0, False, 1, 2, None) for m in range(5)] + [(m, 0, k, None, None, None, None, None, float(10 * m + k)) for m in range(5) for k in (1, 2)]
    schema = "model_id bigint, tree_id bigint, node_id bigint, feature string, threshold double, default_left boolean, left_id bigint, right_id bigint, leaf_value double"
    stored, df = spark.createDataFrame(nodes, schema), spark.createDataFrame([(1, 0.5), (2, None)], "id long, x double")
    got = {(r["id"], r["model_id"]): r["score"] for r in models.score_tree_table(df, stored, ["id"], most=7).collect()}
    assert got == {(i, m): 10.0 * m + i for i in (1, 2) for m in range(5)}
    assert {r["id"]: r["prediction"] for r in models.predict_stored(df, stored, most=7).collect()} == {1: 21.0, 2: 22.0}
    with pytest.raises(ValueError, match="3 nodes"):
        models.score_tree_table(df, stored, ["id"], most=2)
