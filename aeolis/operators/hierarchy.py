"""Groups of turbines: roll-up, masks, and coherent forecasts.

The hierarchy is an edge table (group_id, turb_id); groups may overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(df: DataFrame, edges: DataFrame, col: str = "patv", step: str = "slot") -> DataFrame:
    """Turbine rows (node 't<id>') and group rows (node = group id): group power = sum of its turbines."""
    upper = df.join(edges, "turb_id").groupBy(F.col("group_id").alias("node"), step).agg(F.sum(col).alias(col))
    base = df.select(node_of_turbine().alias("node"), step, col)
    return base.unionByName(upper)


def rollup_mask(df: DataFrame, edges: DataFrame, mask: str = "mask", step: str = "slot") -> DataFrame:
    """A group is usable only where all its turbines are."""
    upper = df.join(edges, "turb_id").groupBy(F.col("group_id").alias("node"), step).agg(F.min(mask).alias(mask))
    return df.select(node_of_turbine().alias("node"), step, mask).unionByName(upper)


def node_of_turbine():
    return F.concat(F.lit("t"), F.col("turb_id").cast("string"))


def constraint_matrix(edges: DataFrame) -> DataFrame:
    """A = [-Su | I] as coordinates (row = group, col = node, value); A y = 0 for a coherent y."""
    turbines = edges.select(F.col("group_id").alias("row"), node_of_turbine().alias("col"), F.lit(-1.0).alias("value"))
    groups = edges.select("group_id").distinct().select(
        F.col("group_id").alias("row"), F.col("group_id").alias("col"), F.lit(1.0).alias("value")
    )
    return turbines.unionByName(groups)


def group_order(edges: DataFrame) -> DataFrame:
    """Groups by size, smallest first: the row order of the matrix."""
    return edges.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_turbines")).orderBy("n_turbines", "group_id")


def coherence_residual(nodes: DataFrame, edges: DataFrame, col: str = "yhat", step: str = "step") -> DataFrame:
    """A y per group and step: group forecast minus the sum of its turbines' forecasts."""
    a = constraint_matrix(edges)
    joined = nodes.join(a, nodes["node"] == a["col"])
    return joined.groupBy(F.col("row").alias("group_id"), step).agg(F.sum(F.col("value") * F.col(col)).alias("residual"))


#: Edges of a hierarchy that are broadcast; the relative residual at which the solver stops; steps times nodes solved for at once.
EDGES, CLOSE, CELLS = 50_000_000, 1e-13, 4_000_000


def _sparse(edges: DataFrame) -> tuple[list[str], list, np.ndarray, np.ndarray]:
    """Groups, turbines, and each edge's group and turbine as numbers. The hierarchy is the model's definition: as large as its edges."""
    if edges.count() > EDGES:
        raise ValueError(f"a hierarchy of more than {EDGES} edges")
    t = edges.select("group_id", "turb_id").distinct().toArrow()
    groups, turbines = t["group_id"].combine_chunks().dictionary_encode(), t["turb_id"].combine_chunks().dictionary_encode()
    return groups.dictionary.to_pylist(), turbines.dictionary.to_pylist(), groups.indices.to_numpy(), turbines.indices.to_numpy()


def conjugate_gradients(
    group: np.ndarray, turbine: np.ndarray, turbines: int, right: np.ndarray, here: np.ndarray | None = None, bound: np.ndarray | None = None
) -> np.ndarray:
    """Solutions v of (Su Su' + I) v = r for every row r, by products with the edges alone; rows with a NaN have none.

    ``here`` and ``bound`` tell for every row which of the ``turbines`` and groups take part (None: all); Su has no others, and
    v is 0 for other groups.
    """
    here = np.ones((len(right), turbines), bool) if here is None else here
    bound = np.ones(right.shape, bool) if bound is None else bound
    order = np.argsort(turbine, kind="stable")
    up = np.argsort(group[order], kind="stable")

    def times(v):
        below = np.zeros(here.shape)
        np.add.at(below.T, turbine[order], v.T[group[order]])
        below *= here
        back = v.copy()
        np.add.at(back.T, group[order][up], below.T[turbine[order][up]])
        return back * bound

    right = np.where(bound, right, 0.0)
    whole = ~np.isnan(right).any(axis=1)
    x, r = np.zeros_like(right), np.where(whole[:, None], right, 0.0)
    p, size = r.copy(), (r * r).sum(axis=1)
    goal = CLOSE * CLOSE * size
    for _ in range(2 * right.shape[1] + 10):
        if (size <= goal).all():
            break
        q = times(p)
        alpha = np.where(size > goal, size / np.maximum((p * q).sum(axis=1), 1e-300), 0.0)[:, None]
        x, r = x + alpha * p, r - alpha * q
        size, before = (r * r).sum(axis=1), size
        p = r + (size / np.maximum(before, 1e-300))[:, None] * p
    return np.where(whole[:, None], x, np.nan)


def reconcile(
    nodes: DataFrame, edges: DataFrame, col: str = "yhat", step: str = "step", u: str | None = None, std: str | None = None, absent_as_zero: bool = False
) -> DataFrame:
    """Orthogonal projection onto coherent forecasts: y' = y - A'(A A')^-1 A y.

    With the columns ``u`` and ``std`` the forecasts are scaled, and (M(std * y + u) - u) / std is returned. A is sparse; the
    residuals of a step meet in one array of the groups' length, the turbines with a forecast in one of theirs, and blocks of steps
    are solved for by conjugate gradients.

    At each step A has the nodes with a forecast there, so that what is returned adds up; a group without a forecast, or without
    one of any of its turbines, constrains nothing. With ``absent_as_zero`` A has all nodes at every step and absent ones count as 0;
    their share of the correction is in no returned row, so that such steps don't add up.
    """
    raw = F.col(col)
    if std is not None:
        raw = raw * F.col(std)
    if u is not None:
        raw = raw + F.col(u)
    level = nodes.withColumn("_level", raw)
    if not absent_as_zero:
        level = level.where("_level IS NOT NULL")
    names, turbines, group, turbine = _sparse(edges)
    held = nodes.sparkSession.sparkContext.broadcast((group, turbine))
    order = {g: i for i, g in enumerate(names)}
    residuals = coherence_residual(level, edges, "_level", step)
    gathered = residuals.groupBy(step).agg(F.collect_list(F.struct("group_id", "residual")).alias("r"))
    if not absent_as_zero:
        present = level.groupBy(step).agg(F.collect_set("node").alias("here"))
        gathered = gathered.join(present, step)
    kind = dict(gathered.dtypes)[step]

    def among(lists, values):
        """Which of the values each list holds."""
        out = np.zeros((len(lists), len(values)), bool)
        at = pc.index_in(lists.flatten(), pa.array(values, pa.string()))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        out[row[known], at.drop_null().to_numpy()] = True
        return out

    def solve(batches):
        group, turbine = held.value
        most = max(1, CELLS // max(len(turbines), len(names), 1))
        for b in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
            right = np.zeros((b.num_rows, len(names)))
            for i, pairs in enumerate(b["r"].to_pylist()):
                for p in pairs:
                    right[i, order[p["group_id"]]] = np.nan if p["residual"] is None else p["residual"]
            here = bound = None
            if not absent_as_zero:
                here = among(b["here"], [f"t{t}" for t in turbines])
                members = np.zeros(right.shape, np.int64)
                np.add.at(members.T, group, here.T[turbine])
                bound = among(b["here"], names) & (members > 0)
            found = conjugate_gradients(group, turbine, len(turbines), right, here, bound) if len(names) else right
            again = pa.array(np.repeat(np.arange(b.num_rows), len(names)))
            rows = pa.array(names * b.num_rows, pa.string())
            yield pa.record_batch([rows, b[step].take(again), pa.array(found.ravel(), from_pandas=True)], ["row", step, "_v"])

    v = gathered.mapInArrow(solve, f"row string, `{step}` {kind}, _v double")
    # each node meets its few matrix entries first, then the correction of that group and step: a group of all
    # turbines is never one join key for all steps
    entries = level.select("node", step).join(constraint_matrix(edges).withColumnRenamed("col", "node"), "node")
    shift = (
        entries.join(v, ["row", step])
        .groupBy("node", step)
        .agg(F.sum(F.col("value") * F.col("_v")).alias("_shift"))
    )
    out = nodes.join(shift, ["node", step], "left")
    moved = F.coalesce("_shift", F.lit(0.0))
    return out.withColumn(col, F.col(col) - (moved / F.col(std) if std is not None else moved)).drop("_shift")
