"""Features of the trailing power series, one row per (turbine, end time), stride 1.

Missing power counts as zero. Two paths, both on bounded (turbine, block) groups:

* features that reduce to a few sums over the window are trailing sums on the JVM, constant cost per row;
* features that need the sorted, shifted, weighted or transformed window itself take each block through Arrow once
  and work on a strided view of it, so the windows are never materialised as rows. (Autocorrelation also reduces to
  sums, but to five for each of nine lags, which measured eight times slower than the strided view.)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeolis.operators.blocks import BLOCK, ENTITY, spread, with_halo
from aeolis.operators.rolling import trailing

# Feature parameters of the stored models (fixed lists).
LOW_QUANTILES = (0.0, 0.2, 0.4, 0.6, 0.8)
FFT_COEFFICIENTS = (1, 7, 11, 16, 22, 33, 45, 58, 61, 63, 79, 85, 89, 90, 93, 94, 96, 97, 98)
AUTOCORR_LAGS = tuple(range(1, 10))
ENTROPY_BINS = (3, 5)
CROSSING_LEVELS = (0, 1)
AR_ORDER = 10
AR_CUT = 1e-10
MASS_SHARE = 0.4
FLAT = 1e-8
TIE = 1e-12


def two_sided_p(t: np.ndarray, dof: int) -> np.ndarray:
    """P(|T| > |t|) of Student's t with integer degrees of freedom, by its finite series."""
    theta = np.arctan(np.abs(t) / np.sqrt(dof))
    c2 = np.cos(theta) ** 2
    odd = dof % 2
    term, total = np.ones_like(c2), np.ones_like(c2)
    for k in range(1, (dof - 3) // 2 + 1 if odd else dof // 2):
        term = term * c2 * (2 * k / (2 * k + 1) if odd else (2 * k - 1) / (2 * k))
        total = total + term
    if odd:
        first = np.sin(theta) * np.cos(theta) * total if dof > 1 else 0.0
        inside = 2 / np.pi * (theta + first)
    else:
        inside = np.sin(theta) * total
    return np.maximum(1 - inside, 0)


def summed_features(
    df: DataFrame, width: int, col: str = "patv", entity: Sequence[str] = ENTITY, pos: str = "time"
) -> DataFrame:
    """Crossings, place of the last maximum and complexity.

    A sum over the steps between window rows is the sum over all rows less that of the first.
    """

    def derive(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_x", F.coalesce(F.col(col).cast("double"), F.lit(0.0)))
        d = d.withColumn("_before", F.coalesce(F.lag("_x").over(w), F.col("_x")))
        crossed = {
            f"_up{m}": ((F.col("_x") > m) != (F.col("_before") > m)).cast("double") for m in CROSSING_LEVELS
        }
        return d.withColumns(
            {
                "_d2": F.pow(F.col("_x") - F.col("_before"), 2),
                "_top": F.struct(F.col("_x").alias("x"), F.col(pos).alias("at")),
                **crossed,
            }
        )

    stepwise = ["_d2", *[f"_up{m}" for m in CROSSING_LEVELS]]
    specs = {"_var": ("var_pop", "_x"), "_max": ("max", "_top")}
    specs |= {f"_all{c}": ("sum", c) for c in stepwise} | {f"_one{c}": ("lag", c, width - 1) for c in stepwise}
    out = trailing(df, specs, width, entity, pos, derive, complete=True)

    n = float(width)
    var = F.col("_var")
    full = var.isNotNull()
    moving = full & (var > FLAT)
    steps = lambda c: F.greatest(F.col(f"_all{c}") - F.col(f"_one{c}"), F.lit(0.0))
    size = F.sqrt(steps("_d2"))
    p = f"{col}__"
    out = out.withColumns(
        {
            **{f"{p}number_crossing_m__m_{m}": F.when(full, steps(f"_up{m}")) for m in CROSSING_LEVELS},
            f"{p}last_location_of_maximum": F.when(full, (F.col("_max.at") - F.col(pos) + width) / n),
            f"{p}cid_ce__normalize_false": F.when(full, size),
            f"{p}cid_ce__normalize_true": F.when(moving, size / F.sqrt(var)).when(full, F.lit(0.0)),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def autocorrelation(w: np.ndarray) -> dict[str, np.ndarray]:
    """Lags 1-9, and the partial form of the first two."""
    n = w.shape[1]
    c = w - w.mean(axis=1, keepdims=True)
    var = (c * c).mean(axis=1)
    var = np.where(var > FLAT, var, np.nan)
    r = {k: np.einsum("ij,ij->i", c[:, :-k], c[:, k:]) / ((n - k) * var) for k in AUTOCORR_LAGS}
    out = {f"autocorrelation__lag_{k}": v for k, v in r.items()}
    out["partial_autocorrelation__lag_1"] = r[1]
    rest = 1 - r[1] ** 2
    out["partial_autocorrelation__lag_2"] = (r[2] - r[1] ** 2) / np.where(rest != 0, rest, np.nan)
    return out


def change_quantiles(w: np.ndarray) -> dict[str, np.ndarray]:
    """Steps with both ends between a low quantile and the maximum: mean size, spread of size and of step."""
    ordered = np.sort(w, axis=1)
    step = np.diff(w, axis=1)
    size, square = np.abs(step), step * step
    total = lambda v, on: np.einsum("ij,ij->i", v, on)
    out = {}
    for q in LOW_QUANTILES:
        at = q * (w.shape[1] - 1)
        low, high = ordered[:, int(np.floor(at))], ordered[:, int(np.ceil(at))]
        inside = w >= (low + (at - np.floor(at)) * (high - low))[:, None]
        pair = (inside[:, 1:] & inside[:, :-1]).astype(float)
        n = np.maximum(pair.sum(axis=1), 1)
        mean, drift, power = total(size, pair) / n, total(step, pair) / n, total(square, pair) / n
        tag = f"qh_10__ql_{str(q).replace('.', '')}"
        out[f"change_quantiles__f_agg_var__isabs_true__{tag}"] = np.maximum(power - mean * mean, 0)
        out[f"change_quantiles__f_agg_var__isabs_false__{tag}"] = np.maximum(power - drift * drift, 0)
        if q > 0:
            out[f"change_quantiles__f_agg_mean__isabs_true__{tag}"] = mean
    return out


def spectrum(w: np.ndarray) -> dict[str, np.ndarray]:
    """Size of chosen Fourier coefficients, and moments of frequency weighted by size."""
    size = np.abs(np.fft.rfft(w, axis=1))
    k = np.arange(size.shape[1], dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = size / size.sum(axis=1, keepdims=True)
        centre = share @ k
        away = k[None, :] - centre[:, None]
        m2, m3, m4 = ((share * away**p).sum(axis=1) for p in (2, 3, 4))
        wide = np.where(m2 >= 0.5, m2, np.nan)
        moments = {"centroid": centre, "variance": m2, "skew": m3 / wide**1.5, "kurtosis": m4 / wide**2}
    out = {f"fft_coefficient__attr_abs__coeff_{c}": size[:, c] for c in FFT_COEFFICIENTS if c < size.shape[1]}
    return out | {f"fft_aggregated__aggtype_{name}": v for name, v in moments.items()}


def fourier_entropy(w: np.ndarray) -> dict[str, np.ndarray]:
    """Entropy of the binned power spectrum (averaged half-overlapping segments, Hann taper, mean removed)."""
    length = min(w.shape[1], 256)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    starts = range(0, w.shape[1] - length + 1, length - length // 2)
    segments = [w[:, s : s + length] for s in starts]
    power = sum(np.abs(np.fft.rfft((s - s.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2 for s in segments)
    power[:, 1 : -1 if length % 2 == 0 else None] *= 2
    top = power.max(axis=1, keepdims=True)
    out = {}
    with np.errstate(invalid="ignore", divide="ignore"):
        rel = power / np.where(top > FLAT, top, np.nan)
        low = rel.min(axis=1, keepdims=True)
        for bins in ENTROPY_BINS:
            slot = np.minimum(np.floor((rel - low) / (1 - low) * bins), bins - 1)
            share = np.stack([(slot == b).mean(axis=1) for b in range(bins)], axis=1)
            entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
            out[f"fourier_entropy__bins_{bins}"] = np.where(top[:, 0] > FLAT, entropy, np.nan)
    return out


def longest_above_mean(w: np.ndarray) -> dict[str, np.ndarray]:
    above = w > w.mean(axis=1, keepdims=True)
    at = np.arange(w.shape[1])
    last_below = np.maximum.accumulate(np.where(above, -1, at), axis=1)
    return {"longest_strike_above_mean": (at - last_below).max(axis=1).astype(float)}


def ar_fit(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the least-squares regression of each window on a constant and its ten lags, the farthest lag first, and how
    far the normal equations are from being met.

    The window is centred and scaled to a deviation of one first. Directions whose eigenvalue lies below ``AR_CUT`` of the largest don't
    count: of all solutions of such a window, that of the smallest weights. Every window is solved by itself, whatever its batch.
    """
    centred = w - w.mean(axis=1, keepdims=True)
    moving = centred.var(axis=1) > FLAT
    weight, off = np.full((len(w), AR_ORDER + 1), np.nan), np.full(len(w), np.nan)
    unit = centred[moving] / np.sqrt(centred[moving].var(axis=1, keepdims=True))
    lagged = np.lib.stride_tricks.sliding_window_view(unit, AR_ORDER + 1, axis=1)
    n = lagged.shape[1]
    # Products of the constant and the lags, without the design itself: sums of products of shifted views.
    gram, right = np.empty((len(unit), AR_ORDER + 1, AR_ORDER + 1)), np.empty((len(unit), AR_ORDER + 1))
    gram[:, 0, 0], right[:, 0] = n, lagged[:, :, AR_ORDER].sum(axis=1)
    for i in range(AR_ORDER):
        gram[:, 0, i + 1] = gram[:, i + 1, 0] = lagged[:, :, i].sum(axis=1)
        right[:, i + 1] = np.einsum("ij,ij->i", lagged[:, :, i], lagged[:, :, AR_ORDER])
        for j in range(i, AR_ORDER):
            gram[:, i + 1, j + 1] = gram[:, j + 1, i + 1] = np.einsum("ij,ij->i", lagged[:, :, i], lagged[:, :, j])
    size, axes = np.linalg.eigh(gram)
    back = np.where(size > AR_CUT * size[:, -1:], 1 / np.where(size > 0, size, 1), 0.0)
    solved = np.einsum("nij,nj,nkj,nk->ni", axes, back, axes, right, optimize=True)
    weight[moving] = solved
    off[moving] = np.abs(np.einsum("nij,nj->ni", gram, solved) - right).max(axis=1, initial=0) / n
    return weight, off


def ar_coefficient(w: np.ndarray) -> dict[str, np.ndarray]:
    """Lag-1 weight of the regression on a constant and ten lags (:func:`ar_fit`)."""
    return {f"ar_coefficient__coeff_1__k_{AR_ORDER}": ar_fit(w)[0][:, -1]}


def index_mass_quantile(w: np.ndarray) -> dict[str, np.ndarray]:
    """Place where the running sum of sizes reaches its share; an exact tie counts despite rounding."""
    mass = np.abs(w).cumsum(axis=1)
    total = mass[:, -1]
    first = (mass >= MASS_SHARE * (1 - TIE) * total[:, None]).argmax(axis=1) + 1
    return {"index_mass_quantile__q_04": np.where(total > 0, first / w.shape[1], np.nan)}


def linear_trend(w: np.ndarray) -> dict[str, np.ndarray]:
    """t statistic and p-value of the slope over time; a flat window has no slope (p = 1)."""
    n = w.shape[1]
    at = np.arange(n) - (n - 1) / 2
    c = w - w.mean(axis=1, keepdims=True)
    both = np.sqrt((at @ at) * np.einsum("ij,ij->i", c, c))
    flat = both <= FLAT
    r = np.clip((w @ at) / np.where(flat, 1, both), -1, 1) * ~flat
    with np.errstate(divide="ignore"):
        t = r * np.sqrt((n - 2) / (1 - r * r))
    return {"linear_trend__statistic": t, "linear_trend__attr_pvalue": two_sided_p(t, n - 2)}


def stepwise(w: np.ndarray) -> dict[str, np.ndarray]:
    """Crossings, place of the last maximum and complexity, as :func:`summed_features` has them."""
    n = w.shape[1]
    out = {}
    for m in CROSSING_LEVELS:
        above = w > m
        out[f"number_crossing_m__m_{m}"] = (above[:, 1:] != above[:, :-1]).sum(axis=1).astype(float)
    out["last_location_of_maximum"] = (n - w[:, ::-1].argmax(axis=1)) / n
    step = np.diff(w, axis=1)
    size, var = np.sqrt(np.einsum("ij,ij->i", step, step)), w.var(axis=1)
    out["cid_ce__normalize_false"] = size
    out["cid_ce__normalize_true"] = np.where(var > FLAT, size / np.sqrt(np.where(var > FLAT, var, 1.0)), 0.0)
    return out


WINDOW_FEATURES = (
    linear_trend,
    autocorrelation,
    change_quantiles,
    spectrum,
    fourier_entropy,
    longest_above_mean,
    ar_coefficient,
    index_mass_quantile,
)


SERIES_FEATURES = (*WINDOW_FEATURES, stepwise)
Features = Sequence[Callable[[np.ndarray], dict[str, np.ndarray]]]


def feature_names(features: Features, width: int) -> list[str]:
    probe = np.arange(2.0 * width).reshape(2, width)
    return [n for f in features for n in f(probe)]


def strided_features(power: pd.Series, width: int, starts: np.ndarray, features: Features) -> dict[str, np.ndarray]:
    """Features of the windows that begin at ``starts`` of a sorted block, a bounded number of windows at a time."""
    parts: dict[str, list[np.ndarray]] = {n: [] for n in feature_names(features, width)}
    if not len(starts):
        return {n: np.empty(0) for n in parts}
    views = np.lib.stride_tricks.sliding_window_view(power.fillna(0.0).to_numpy(dtype=float), width)
    batch = max(1, 2**17 // width)
    for at in range(0, len(starts), batch):
        w = views[starts[at : at + batch]]
        for f in features:
            for name, v in f(w).items():
                parts[name].append(v)
    return {n: np.concatenate(v) for n, v in parts.items()}


def window_features(
    df: DataFrame,
    width: int,
    features: Features = WINDOW_FEATURES,
    col: str = "patv",
    entity: Sequence[str] = ENTITY,
    pos: str = "time",
    size: int = 2048,
    stride: int = 1,
) -> DataFrame:
    """(entity, pos, features) for every ``stride``-th end time with a full window."""
    names = feature_names(features, width)
    narrow = with_halo(df.select(*entity, pos, F.col(col).cast("double").alias(col)), pos, size, back=width - 1)
    keys = [f for f in narrow.schema.fields if f.name in (*entity, pos)]
    schema = T.StructType([*keys, *[T.StructField(f"{col}__{n}", T.DoubleType()) for n in names]])
    kept = [f.name for f in keys]

    def compute(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(pos, kind="stable")
        ends = block.iloc[width - 1 :]
        chosen = np.flatnonzero(ends["_own"].to_numpy() & ((ends[pos].to_numpy() - (width - 1)) % stride == 0))
        if not len(chosen):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        new = strided_features(block[col], width, chosen, features)
        return ends.iloc[chosen][kept].assign(**{f"{col}__{n}": v for n, v in new.items()})

    return spread(narrow, *entity, "_blk").groupBy(*entity, "_blk").applyInPandas(compute, schema)


def series_features(
    df: DataFrame, width: int, col: str = "patv", entity: Sequence[str] = ENTITY, pos: str = "time", size: int = 2048
) -> DataFrame:
    """All series features per (entity, pos), in one exchange; rows before the first full window are left out."""
    windowed = window_features(df, width, SERIES_FEATURES, col, entity, pos, size)
    return windowed.drop(f"{col}__linear_trend__statistic")


def series_windows(
    df: DataFrame, width: int, col: str = "patv", entity: Sequence[str] = ENTITY, pos: str = "time", size: int = BLOCK
) -> DataFrame:
    """The windows themselves as arrays, oldest value first (for a model edge; features never need them)."""
    haloed = with_halo(df, pos, size, back=width - 1)
    frame = Window.partitionBy(*entity, "_blk").orderBy(pos).rowsBetween(1 - width, 0)
    out = haloed.withColumn("window", F.collect_list(F.coalesce(F.col(col), F.lit(0.0))).over(frame))
    return out.filter(F.col("_own") & (F.size("window") == width)).select(*entity, pos, "window")
