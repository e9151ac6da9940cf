"""Linear models of the horizon's segments, all solved from cross products that one pass over the panel adds up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeolis.operators.blocks import BLOCK, ENTITY, with_halo

# Inputs drawn from the steps up to a sample's anchor, and from its clock (fixed lists).
WINDOW_INPUTS = ("last_patv", "mean_patv", "mean_wspd", "known_share")
CLOCK_INPUTS = ("hour_sin", "hour_cos")
#: Share of the largest eigenvalue below which a direction counts as constant and gets no weight.
CUT = 1e-10
Segment = tuple[int, int]


def label_of(segment: Segment) -> str:
    return f"y_{segment[0]}_{segment[1]}"


def segment_samples(
    df: DataFrame,
    input_lens: Sequence[int],
    segments: Sequence[Segment],
    steps_per_day: int,
    keep: Sequence[str] = (),
    entity: Sequence[str] = ENTITY,
    pos: str = "slot",
    size: int = BLOCK,
) -> DataFrame:
    """One row for every step with a full window of some length: (entity, anchor, keep, inputs, labels), all single numbers.

    For each of ``input_lens`` the last known power, the means and the known share of the steps up to the anchor (``mean_patv_48``);
    for each segment (start, end) the mean known power of the steps start + 1 to end behind the anchor (``y_0_6``), NULL where the grid
    ends before or nothing is known. ``pos`` must be gap-free. One exchange: blocks of steps meet their neighbours on both
    sides, and every mean is a difference of running sums.
    """
    back, ahead = max(input_lens) - 1, max((e for _, e in segments), default=0)
    narrow = df.select(*entity, pos, *keep, F.col("patv").cast("double").alias("patv"), F.col("wspd").cast("double").alias("wspd"))
    haloed = with_halo(narrow, pos, size, back, ahead)
    names = [f"{c}_{n}" for n in input_lens for c in WINDOW_INPUTS] + [label_of(s) for s in segments]
    fields = [f for f in narrow.schema.fields if f.name in (*entity, *keep)]
    schema = T.StructType([*fields, T.StructField("anchor", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def windows(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(pos, kind="stable")
        n, at = len(block), np.arange(len(block))
        known, total = {}, {}
        for c in ("patv", "wspd"):
            x = block[c].to_numpy(dtype=float)
            known[c] = np.concatenate([[0], np.cumsum(~np.isnan(x))])
            total[c] = np.concatenate([[0.0], np.cumsum(np.nan_to_num(x))])
        patv = block["patv"].to_numpy(dtype=float)
        last = np.maximum.accumulate(np.where(np.isnan(patv), -1, at))

        def mean(c, low, high):
            """Mean of what is known at the places low to high - 1."""
            count = known[c][high] - known[c][low]
            return np.where(count > 0, (total[c][high] - total[c][low]) / np.maximum(count, 1), np.nan)

        out = {}
        for width in input_lens:
            full, low = at >= width - 1, np.maximum(at + 1 - width, 0)
            out[f"last_patv_{width}"] = np.where(last >= low, patv[np.maximum(last, 0)], np.nan)
            out[f"mean_patv_{width}"], out[f"mean_wspd_{width}"] = mean("patv", low, at + 1), mean("wspd", low, at + 1)
            out[f"known_share_{width}"] = (known["patv"][at + 1] - known["patv"][low]) / width
            for c in WINDOW_INPUTS:
                out[f"{c}_{width}"] = np.where(full, out[f"{c}_{width}"], np.nan)
        for start, end in segments:
            inside = at + end < n
            low, high = np.minimum(at + start + 1, n), np.minimum(at + end + 1, n)
            out[label_of((start, end))] = np.where(inside, mean("patv", low, high), np.nan)
        own = block["_own"].to_numpy() & (at >= min(input_lens) - 1)
        made = block[[f.name for f in fields]].assign(anchor=block[pos].astype("int64"), **out)
        return made[own]

    out = haloed.groupBy(*entity, "_blk").applyInPandas(windows, schema)
    turn = 2 * F.pi() * ((F.col("anchor") + 1) % steps_per_day) / steps_per_day
    clean = {n: F.when(~F.isnan(n), F.col(n)) for n in names}  # pandas has no NULL among doubles
    return out.withColumns(clean | {"hour_sin": F.sin(turn), "hour_cos": F.cos(turn)})


@dataclass(frozen=True)
class Part:
    """The samples of some models: a segment's, with windows of a length, up to a day (None: all)."""

    segment: Segment
    input_len: int
    last_day: int | None = None


def inputs_of(input_len: int, window: Sequence[str] = WINDOW_INPUTS, other: Sequence[str] = CLOCK_INPUTS) -> list[str]:
    return [f"{c}_{input_len}" if c in WINDOW_INPUTS else c for c in (*window, *other)]


def cross_products(samples: DataFrame, parts: Sequence[Part], window: Sequence[str] = WINDOW_INPUTS, other: Sequence[str] = CLOCK_INPUTS) -> dict[Part, np.ndarray]:
    """For each part the sums of all products of (1, inputs, label) over its samples without unknown numbers. One job for all parts.

    Tasks add their rows up, Spark adds up the tasks; a small matrix a part reaches the driver.
    """
    lens = sorted({p.input_len for p in parts})
    columns = sorted({c for n in lens for c in inputs_of(n, window, other)} | {label_of(p.segment) for p in parts})
    days = any(p.last_day is not None for p in parts)
    rows = samples.select(*columns, *(["day"] if days else []))

    def add(batches):
        sums = {}
        for batch in batches:
            x = {c: batch[c].to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names}
            for k, p in enumerate(parts):
                z = np.column_stack([np.ones(batch.num_rows), *(x[c] for c in inputs_of(p.input_len, window, other)), x[label_of(p.segment)]])
                mine = ~np.isnan(z).any(axis=1)
                if p.last_day is not None:
                    mine &= x["day"] <= p.last_day
                sums[k] = sums.get(k, 0) + z[mine].T @ z[mine]
        for k, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.record_batch([pa.array(np.full(s.size, k)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(s.ravel())], ["part", "i", "j", "s"])

    found = rows.mapInArrow(add, "part long, i long, j long, s double").groupBy("part", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = {p: np.zeros((len(window) + len(other) + 2,) * 2) for p in parts}
    for r in found:
        out[parts[r["part"]]][r["i"], r["j"]] = r["s"]
    return out


@dataclass
class SegmentModel:
    """A linear model of a segment's mean power; unknown inputs count as their mean in training."""

    part: Part
    regularisation: float
    intercept: float
    weights: dict[str, float]
    means: dict[str, float]
    samples: int

    def predict(self) -> Column:
        terms = [F.lit(w) * F.coalesce(c, F.lit(self.means[c])) for c, w in self.weights.items()]
        return sum(terms, F.lit(self.intercept))


def solve(products: np.ndarray, part: Part, inputs: Sequence[str], use: Sequence[str], regularisation: float) -> SegmentModel:
    """Ridge regression on the inputs ``use``; the penalty counts in standard deviations of each input. No samples: the mean is 0."""
    n = products[0, 0]
    at = [1 + list(inputs).index(c) for c in use]
    if not n:
        return SegmentModel(part, regularisation, 0.0, dict.fromkeys(use, 0.0), dict.fromkeys(use, 0.0), 0)
    mean, goal = products[0, at] / n, products[0, -1] / n
    spread = products[np.ix_(at, at)] / n - np.outer(mean, mean)
    both = products[at, -1] / n - mean * goal
    scale = np.sqrt(np.maximum(np.diag(spread), 0.0))
    live = scale > CUT * np.maximum(np.abs(mean), 1.0)
    unit = np.where(live, scale, 1.0)
    size, axes = np.linalg.eigh(spread / np.outer(unit, unit) * np.outer(live, live))
    # A direction in which the samples don't differ has no weight.
    keep = size > CUT * max(size.max(initial=0.0), CUT)
    inverse = (axes[:, keep] / (size[keep] + regularisation)) @ axes[:, keep].T
    weight = inverse @ (both / unit * live) / unit
    return SegmentModel(part, regularisation, float(goal - mean @ weight), dict(zip(use, map(float, weight))), dict(zip(use, map(float, mean))), int(n))


def train_segment_models(
    samples: DataFrame,
    segments: Sequence[Segment],
    input_len: int,
    regularisation: Sequence[float] = (0.0, 0.1),
    window: Sequence[str] = WINDOW_INPUTS,
    other: Sequence[str] = CLOCK_INPUTS,
) -> list[SegmentModel]:
    """One model for each segment and penalty."""
    parts = [Part(s, input_len) for s in segments]
    products, inputs = cross_products(samples, parts, window, other), inputs_of(input_len, window, other)
    return [solve(products[p], p, inputs, inputs, r) for p in parts for r in regularisation]


def train_grid_models(samples: DataFrame, grid: Sequence[Mapping], steps_per_day: int, segments: Mapping[int, Segment]) -> list[SegmentModel]:
    """One model for each configuration of the grid (days, hidden1, hidden2, output_len, partial_days, attention), from one job.

    days is the window, partial_days the last day of training, and output_len names a segment. The grid is one of nets; a linear model takes
    their size as the inverse of its penalty, and attention as the clock inputs.
    """
    parts = [Part(segments[g["output_len"]], g["days"] * steps_per_day, g["partial_days"]) for g in grid]
    products, out = cross_products(samples, list(dict.fromkeys(parts))), []
    for g, p in zip(grid, parts, strict=True):
        inputs = inputs_of(p.input_len)
        use = inputs if g["attention"] else [c for c in inputs if c not in CLOCK_INPUTS]
        out.append(solve(products[p], p, inputs, use, 64.0 / (g["hidden1"] * g["hidden2"])))
    return out


def score_segment_models(samples: DataFrame, fitted: Sequence[SegmentModel], keys: Sequence[str]) -> DataFrame:
    """(keys, seg_start, seg_end, reg, yhat): one row for every sample and fitted model, whatever inputs are unknown."""
    structs = [
        F.struct(
            F.lit(m.part.segment[0]).cast("bigint").alias("seg_start"),
            F.lit(m.part.segment[1]).cast("bigint").alias("seg_end"),
            F.lit(float(m.regularisation)).alias("reg"),
            m.predict().alias("yhat"),
        )
        for m in fitted
    ]
    return samples.select(*keys, F.explode(F.array(*structs)).alias("s")).select(*keys, "s.*")
