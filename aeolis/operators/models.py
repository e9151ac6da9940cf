"""Tree ensembles: features, training, scoring from a stored node table, configuration grids."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolis.functions.scalar import known, with_curve
from aeolis.operators import farm
from aeolis.operators.boosting import Booster, BoostSettings, fit
from aeolis.settings import NOT_FEATURES

MISSING = -9999.0

# Inputs of the two power-repair models (fixed lists).
REPAIR_INPUTS = ("turb_id", "wspd", "wdir", "etmp", "itmp", "ndir", "prtv")
FARM_REPAIR_INPUTS = (
    "turb_id", "sin_tm", "cos_tm", "etmp", "itmp", "wspd",
    "wdir", "patv_mean", "etmp_median", "itmp_median", "wspd_mean", "mask_mean",
)

# Seeds and sampling shares of the long-horizon ensemble (fixed lists).
SEEDS = (50, 100, 500, 1000, 2000)
SHARES = (0.6, 0.8)

# The two configuration grids of the short-horizon leg (fixed lists).
GRID_MAIN = {
    "days": (2, 4, 7), "hidden1": (64, 128), "hidden2": (8, 16),
    "output_len": (12, 36, 72, 144, 288), "partial_days": (None, 140), "attention": (True, False),
}
GRID_TEMPERATURE = {
    "days": (2, 4, 7), "hidden1": (64,), "hidden2": (8, 16),
    "output_len": (108, 216), "partial_days": (None, 140), "attention": (True, False),
}


def feature_columns(df: DataFrame, deny: Sequence[str] = NOT_FEATURES) -> list[str]:
    numeric = {"double", "float", "int", "bigint"}
    return [c for c, t in df.dtypes if c not in deny and t in numeric]


def feature_stages(cols: Sequence[str], categorical: str | None = "turb_id") -> list:
    """Assemble the inputs; the turbine may be coded as a category (as many bins as turbines are needed then)."""
    if categorical not in cols:
        return [VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")]
    code = StringIndexer(
        inputCol=categorical, outputCol="_code", handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    coded = ["_code" if c == categorical else c for c in cols]
    return [code, VectorAssembler(inputCols=coded, outputCol="features", handleInvalid="keep")]


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """For vectors, which know no missing value: a missing input becomes one value below all others."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in cols})


def train_boosted_trees(
    train: DataFrame,
    cols: Sequence[str],
    label: str = "target",
    validation: str | None = None,
    rounds: int = 500,
    rate: float = 0.03,
    share: float = 0.6,
    leaves: int = 31,
    seed: int = 50,
    patience: int = 10,
    categorical: str | None = "turb_id",
    **more,
) -> Booster:
    """Squared-error boosting on histograms (:mod:`aeolis.operators.boosting`). ``validation`` names a boolean column whose true
    rows only decide which round is the best; ``categorical`` an input whose values have no order."""
    settings = BoostSettings(rounds, rate, leaves, share, share, seed=seed, patience=patience, **more)
    return fit(train, cols, label, validation, [c for c in (categorical,) if c in cols], settings)


def predict(model: Booster, df: DataFrame, out: str = "pred_target") -> DataFrame:
    """Prediction next to the untouched columns."""
    return predict_mean([model], df, out)


def predict_mean(members: Sequence[Booster], df: DataFrame, out: str = "pred_target") -> DataFrame:
    """Mean prediction of several members, in one pass over the rows."""
    rows = [(k, *r[1:]) for k, m in enumerate(members) for r in m.rows]
    return _with_mean(df, NodeTable.of([dict(zip(NODE_COLUMNS, r)) for r in rows]), out)


def feature_importance(model: Booster, spark, n: int | None = None) -> DataFrame:
    """Ranking of the inputs by their share of the gain; as many rows as inputs."""
    ranked = spark.createDataFrame(model.importance(), "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked if n is None else ranked.limit(n)


#: Nodes that are collected and broadcast at once; larger ensembles are scored model by model.
NODES = 2_000_000


@dataclass
class NodeTable:
    """A stored ensemble as arrays: one row for each node, children as row numbers, -1 for a leaf."""

    roots: np.ndarray
    models: np.ndarray
    names: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    default_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    #: Categories that occur in a set, and for each node its row in ``sets`` (-1: split by threshold).
    levels: np.ndarray
    set_of: np.ndarray
    sets: np.ndarray

    @classmethod
    def of(cls, nodes: Sequence[Mapping]) -> NodeTable:
        rows = sorted(nodes, key=lambda r: (r["model_id"], r["tree_id"], r["node_id"]))
        at = {(r["model_id"], r["tree_id"], r["node_id"]): i for i, r in enumerate(rows)}
        names = sorted({r["feature"] for r in rows if r["left_id"] is not None})
        place = {c: i for i, c in enumerate(names)}
        child = lambda r, side: -1 if r["left_id"] is None else at[r["model_id"], r["tree_id"], r[side]]
        inner = lambda f, empty: np.array([empty if r["left_id"] is None else f(r) for r in rows])
        trees = sorted({(r["model_id"], r["tree_id"]) for r in rows})
        named = [i for i, r in enumerate(rows) if r.get("left_set") is not None]
        levels = np.array(sorted({v for i in named for v in rows[i]["left_set"]}), float)
        set_of, sets = np.full(len(rows), -1), np.zeros((len(named), len(levels) + 1), bool)
        for k, i in enumerate(named):
            set_of[i] = k
            sets[k, np.searchsorted(levels, rows[i]["left_set"])] = True
        return cls(
            np.array([at[m, t, 0] for m, t in trees], np.int64),
            np.array([m for m, _ in trees], np.int64),
            names,
            inner(lambda r: place[r["feature"]], 0).astype(np.int64),
            inner(lambda r: math.nan if r["threshold"] is None else float(r["threshold"]), 0.0).astype(np.float64),
            inner(lambda r: bool(r["default_left"]), False).astype(bool),
            np.array([child(r, "left_id") for r in rows], np.int64),
            np.array([child(r, "right_id") for r in rows], np.int64),
            np.array([float(r["leaf_value"]) if r["left_id"] is None else 0.0 for r in rows]),
            levels, set_of, sets,
        )

    def _goes_left(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        low = value <= self.threshold[at]
        if len(self.sets):
            k = np.searchsorted(self.levels, value)
            known = np.append(self.levels, np.nan)[k] == value
            low = np.where(self.set_of[at] >= 0, self.sets[self.set_of[at], np.where(known, k, len(self.levels))], low)
        return np.where(np.isnan(value), self.default_left[at], low)

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model ids, and (rows, models) sums over each model's trees of the leaf every row reaches."""
        ids = np.unique(self.models)
        out = np.zeros((len(x), len(ids)))
        rows = np.arange(len(x))
        for root, model in zip(self.roots, self.models):
            at = np.full(len(x), root)
            inner = self.left[at] >= 0
            while inner.any():
                goes_left = self._goes_left(at, x[rows, self.feature[at]])
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
                inner = self.left[at] >= 0
            out[:, np.searchsorted(ids, model)] += self.value[at]
        return ids, out


NODE_COLUMNS = ("model_id", "tree_id", "node_id", "feature", "threshold", "default_left", "left_id", "right_id", "leaf_value", "left_set", "gain", "rows")


def node_tables(nodes: DataFrame, most: int = NODES) -> list[NodeTable]:
    """Arrays of a node table (model_id, tree_id, node_id, feature, threshold, default_left, left_id, right_id, leaf_value and, for
    categories, left_set), as many of at most ``most`` nodes as it takes; a model is never split."""
    sizes = nodes.groupBy("model_id").agg(F.count("*").alias("n")).orderBy("model_id").collect()  # one row a model
    parts: list[list[int]] = []
    held = most + 1
    for r in sizes:
        if r["n"] > most:
            raise ValueError(f"model {r['model_id']} has {r['n']} nodes; at most {most} fit into one table")
        if held + r["n"] > most:
            parts.append([])
            held = 0
        parts[-1].append(r["model_id"])
        held += r["n"]
    return [NodeTable.of([r.asDict() for r in nodes.where(F.col("model_id").isin(p)).collect()]) for p in parts]


def score_tree_table(df: DataFrame, nodes: DataFrame, keys: Sequence[str], most: int = NODES) -> DataFrame:
    """(keys, model_id, score): every row scored by every stored model, in narrow passes over Arrow blocks without a join.

    The arrays are broadcast, ``most`` nodes at once; a larger ensemble takes a pass for each part of it.
    """
    parts = [_scored(df, t, keys) for t in node_tables(nodes, most)]
    kinds = df.select(*keys).schema.add("model_id", "long").add("score", "double")
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], kinds)


def _scored(df: DataFrame, table: NodeTable, keys: Sequence[str]) -> DataFrame:
    inputs = [f"_x{i}" for i in range(len(table.names))]
    rows = df.select(*keys, *[F.col(c).cast("double").alias(x) for c, x in zip(table.names, inputs)])
    # plain arrays: unlike the tasks' functions, broadcast values can't bring their classes along
    held = df.sparkSession.sparkContext.broadcast(vars(table))

    def run(batches):
        stored = NodeTable(**held.value)
        for b in batches:
            x = np.full((b.num_rows, max(1, len(inputs))), np.nan)
            for i, c in enumerate(inputs):
                x[:, i] = b[c].to_numpy(zero_copy_only=False)
            ids, scores = stored.score(x)
            again = pa.array(np.repeat(np.arange(b.num_rows), len(ids)))
            cols = [b[k].take(again) for k in keys]
            yield pa.record_batch(
                [*cols, pa.array(np.tile(ids, b.num_rows), pa.int64()), pa.array(scores.ravel(), pa.float64())],
                [*keys, "model_id", "score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return rows.mapInArrow(run, f"{kinds}, model_id bigint, score double")


def _with_mean(df: DataFrame, table: NodeTable, out: str) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(vars(table))

    @F.pandas_udf("double")
    def mean(x: pd.DataFrame) -> pd.Series:
        return pd.Series(NodeTable(**held.value).score(x.to_numpy(dtype=float, na_value=np.nan))[1].mean(axis=1))

    inputs = [F.col(c).cast("double").alias(c) for c in table.names] or [F.lit(0.0).alias("none")]
    return df.withColumn(out, mean(F.struct(*inputs)))


def predict_stored(df: DataFrame, nodes: DataFrame, out: str = "prediction", most: int = NODES) -> DataFrame:
    """Mean score of a stored ensemble's models next to the untouched columns, for the repair step."""
    tables = node_tables(nodes, most)
    for k, t in enumerate(tables):
        df = _with_mean(df, t, f"_part{k}")
    counts = [len(np.unique(t.models)) for t in tables]
    total = reduce(lambda a, b: a + b, [F.col(f"_part{k}") * n for k, n in enumerate(counts)])
    return df.withColumn(out, total / sum(counts)).drop(*[f"_part{k}" for k in range(len(tables))])


def mean_ensemble(preds: DataFrame, keys: Sequence[str] = ("turb_id", "step"), col: str = "yhat") -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(col).alias(col))


def ensemble_grid() -> list[dict]:
    """Seed x sampling share of the long-horizon ensemble."""
    return [{"seed": s, "share": c} for s, c in itertools.product(SEEDS, SHARES)]


def grid_rows(spark, grids: Mapping[str, Mapping[str, Sequence]], day_steps: int) -> DataFrame:
    """All combinations of each grid, one row per configuration; ``input_len`` is days in steps."""
    rows = [
        (name, *combo) for name, grid in grids.items() for combo in itertools.product(*(grid[k] for k in GRID_MAIN))
    ]
    schema = "grid string, days bigint, hidden1 bigint, hidden2 bigint, output_len bigint, partial_days bigint, attention boolean"
    return spark.createDataFrame(rows, schema).withColumn("input_len", F.col("days") * day_steps)


def grid_sample_counts(grid: DataFrame, panel: DataFrame, day_limits: Sequence[int | None]) -> DataFrame:
    """Training samples each configuration gets: N - in - out + 1, N the grid steps within its ``partial_days``.

    The panel is reduced to one row per day, then to one row with a sum per day limit, used as a scalar.
    """
    per_day = panel.groupBy("day").agg(F.count_distinct("slot").alias("n"))
    sums = [
        F.sum("n" if limit is None else F.when(F.col("day") <= limit, F.col("n"))).alias(f"upto_{limit}")
        for limit in day_limits
    ]
    steps = per_day.agg(F.struct(*sums)).scalar()
    out = grid.withColumn("_steps", steps)
    chosen = F.lit(None).cast("bigint")
    for limit in day_limits:
        mine = F.col("partial_days").isNull() if limit is None else F.col("partial_days") == limit
        chosen = F.when(mine, F.col(f"_steps.upto_{limit}")).otherwise(chosen)
    samples = F.greatest(chosen - F.col("input_len") - F.col("output_len") + 1, F.lit(0))
    return out.withColumn("samples", F.coalesce(samples, F.lit(0)).cast("bigint")).drop("_steps")


def farm_repair_inputs(df: DataFrame, curve: DataFrame, wdir: DataFrame) -> DataFrame:
    """Rows of the short-horizon leg (mask, clock, ``raw_patv``) with the farm statistics the repair model reads."""
    rows = with_curve(df, curve).withColumn("mask2", known(F.col("raw_patv") > F.col("max_patv")))
    medians = farm.farm_medians(rows, ["etmp", "itmp"])
    rows = farm.join_time(rows, medians)
    good = (F.col("mask") == 1) & ~F.col("mask2")
    at_time = rows.groupBy(*farm.TIME).agg(
        F.avg(F.when(good, F.col("patv"))).alias("patv_mean"),
        F.avg(F.when(good, F.col("wspd"))).alias("wspd_mean"),
        F.avg("mask").alias("mask_mean"),
    )
    rows = farm.join_time(rows, at_time)
    return rows.join(wdir, ["turb_id", "slot"], "left")
