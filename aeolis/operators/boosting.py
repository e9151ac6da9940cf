"""Squared-error boosting of regression trees on histograms that Spark adds up.

Inputs become bins once. A wave of leaves is split per job: every task adds its rows' gradients up by (leaf, input, bin), Spark adds the
tasks' histograms up, and one task a leaf looks for the best split. Only splits reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolis.session import stage

#: Rows of a block of binned rows; rounds after which the rows' predictions are written anew; rows that smooth a category's mean.
BLOCK, KEEP, SMOOTH = 65_536, 16, 10.0
NODE_SCHEMA = (
    "model_id bigint, tree_id bigint, node_id bigint, feature string, threshold double, default_left boolean, left_id bigint, "
    "right_id bigint, leaf_value double, left_set array<double>, gain double, rows bigint"
)
HISTORY_SCHEMA = "model_id bigint, round bigint, train_rmse double, valid_rmse double, best boolean"


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 500
    rate: float = 0.03
    leaves: int = 31
    #: Shares of the rows and of the inputs that a tree sees.
    row_share: float = 0.6
    col_share: float = 0.6
    l1: float = 0.1
    l2: float = 0.1
    min_rows: int = 20
    #: Rounds without a smaller validation error after which training stops.
    patience: int = 10
    bins: int = 255
    seed: int = 50


@dataclass
class Booster:
    """Node rows (see ``NODE_SCHEMA``) up to the best round, and the errors of every round."""

    rows: list[tuple]
    history: list[tuple]
    cols: list[str] = field(default_factory=list)

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, NODE_SCHEMA)

    def errors(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY_SCHEMA)

    def importance(self) -> list[tuple[str, float]]:
        """Share of the gain that each input's splits brought, largest first."""
        gain = dict.fromkeys(self.cols, 0.0)
        for r in self.rows:
            if r[6] is not None:
                gain[r[3]] += r[10]
        total = sum(gain.values()) or 1.0
        return sorted(((c, g / total) for c, g in gain.items()), key=lambda x: (-x[1], x[0]))


def borders_of(rows: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Upper borders of each input's bins, the last one open: its distinct approximate quantiles."""
    marks = [(i + 1) / bins for i in range(bins - 1)]
    got = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), marks, 10_000).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    return {c: sorted(set(got[i] or [])) for i, c in enumerate(cols)}


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(g: np.ndarray, n: np.ndarray, missing: tuple[float, int], s: BoostSettings, category: bool):
    """(gain, bins that go left, default_left) of one input's histogram in one leaf, or None.

    Bins are ordered as they are, categories by their smoothed mean; missing values go the way that gains more.
    """
    order = np.argsort(g / (n + SMOOTH), kind="stable") if category else np.arange(len(g))
    if category:
        order = order[n[order] > 0]
    left_g, left_n = np.cumsum(g[order])[:-1], np.cumsum(n[order])[:-1]
    all_g, all_n = g.sum() + missing[0], n.sum() + missing[1]
    score = lambda a, b: soft(a, s.l1) ** 2 / (b + s.l2)
    best = None
    for default_left in (False, True):
        lg, ln = (left_g + missing[0], left_n + missing[1]) if default_left else (left_g, left_n)
        rg, rn = all_g - lg, all_n - ln
        gain = np.where((ln >= s.min_rows) & (rn >= s.min_rows), score(lg, ln) + score(rg, rn) - score(all_g, all_n), -np.inf)
        if len(gain) and gain.max() > 0 and (best is None or gain.max() > best[0]):
            at = int(gain.argmax())
            best = (float(gain[at]), order[: at + 1], default_left, float(lg[at]), int(ln[at]))
    return best


@dataclass
class Tree:
    """A tree over bins. Nodes: [input, bins that go left as a mask, default_left, left, right, value, gain, rows]."""

    nodes: list[list]

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row of codes (the last code of an input: missing) ends in."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        open_ = np.full(len(codes), self.nodes[0][3] >= 0)
        while open_.any():
            for node in np.unique(at[open_]):
                col, mask, _, left, right, *_ = self.nodes[node]
                mine = rows[open_ & (at == node)]
                at[mine] = np.where(mask[codes[mine, col]], left, right)
            open_ = np.array([x[3] >= 0 for x in self.nodes])[at]
        return at

    def value(self, codes: np.ndarray) -> np.ndarray:
        return np.array([x[5] for x in self.nodes])[self.leaf(codes)]


def _unpack(row: dict, cols: int):
    n = row["n"]
    codes = np.frombuffer(row["codes"], np.int32).reshape(n, cols)
    return codes, np.frombuffer(row["y"]), np.frombuffer(row["held"], bool), np.frombuffer(row["h"], np.int64), np.frombuffer(row["score"])


BLOCK_SCHEMA = "n long, codes binary, y binary, held binary, h binary, score binary"


def _binned(rows: DataFrame, cols: Sequence[str], borders: dict, levels: dict, label: str, held: str | None, base: float) -> DataFrame:
    """Blocks of rows as bin numbers; a missing value gets the number behind the last bin."""
    picked = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("_y"), (F.col(held) if held else F.lit(False)).alias("_held"))
    picked = picked.withColumn("_h", F.xxhash64(*picked.columns))

    def pack(batches):
        for batch in batches:
            codes = np.empty((batch.num_rows, len(cols)), np.int32)
            for i, c in enumerate(cols):
                x = batch[f"_{i}"].to_numpy(zero_copy_only=False)
                edges = np.array(levels.get(c, borders.get(c)))
                k = np.searchsorted(edges, x, side="left")
                if c in levels and len(edges):  # a category never seen has a bin of its own, which no split sends left
                    k = np.where(edges[np.minimum(k, len(edges) - 1)] == x, k, len(edges))
                codes[:, i] = np.where(np.isnan(x), len(edges) + 1, k)
            y = batch["_y"].to_numpy(zero_copy_only=False)
            held_ = batch["_held"].to_numpy(zero_copy_only=False).astype(bool)
            h = batch["_h"].to_numpy()
            for at in range(0, batch.num_rows, BLOCK):
                part = slice(at, at + BLOCK)
                cells = [codes[part].tobytes(), y[part].tobytes(), held_[part].tobytes(), h[part].tobytes(), np.full(len(y[part]), base).tobytes()]
                yield pa.record_batch([pa.array([len(y[part])]), *(pa.array([c], pa.binary()) for c in cells)], ["n", "codes", "y", "held", "h", "score"])

    return stage(picked.mapInArrow(pack, BLOCK_SCHEMA), "boost-rows")


def _in_sample(h: np.ndarray, tree: int, s: BoostSettings) -> np.ndarray:
    """Rows are drawn by a hash of their content, so that a repeated task draws the same ones."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) + np.uint64((s.seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < s.row_share


def _wave(blocks: DataFrame, trees: list[Tree], tree: Tree, leaves: list[int], used: list[int], sizes: list[int], number: int, cats: set[int], unit: float, s: BoostSettings):
    """The best split of each leaf and, with the root, the errors of the ensemble so far."""
    spark = blocks.sparkSession
    cols, width = len(sizes), max(sizes)
    # plain lists and arrays: unlike the tasks' functions, broadcast values can't bring their classes along
    state = spark.sparkContext.broadcast([t.nodes for t in (*trees, tree)])

    def add(batches):
        *done, current = [Tree(nodes) for nodes in state.value]
        g = np.zeros((len(leaves), cols, width), np.int64)
        n = np.zeros_like(g)
        errors = np.zeros((2, 2))
        for batch in batches:
            for row in batch.to_pylist():
                codes, y, held, h, score = _unpack(row, cols)
                for t in done:
                    score = score + t.value(codes)
                residual = score - y
                if leaves == [0]:
                    for side, mine in enumerate((~held, held)):
                        errors[side] += (residual[mine] ** 2).sum(), mine.sum()
                mine = ~held & _in_sample(h, number, s)
                at = current.leaf(codes[mine])
                grad = np.rint(residual[mine] / unit).astype(np.int64)
                for k, leaf in enumerate(leaves):
                    in_leaf = at == leaf
                    for c in used:
                        code = codes[mine][in_leaf, c]
                        n[k, c] += np.bincount(code, minlength=width)
                        # Whole numbers: below 2^53 in a block, as a gradient has about 2^30 units and a block 2^16 rows.
                        g[k, c] += np.bincount(code, grad[in_leaf], width).astype(np.int64)
        k, c, b = np.nonzero(n)
        out = [(np.array(leaves)[k], c, b, g[k, c, b], n[k, c, b], np.zeros(len(k)))]
        if leaves == [0]:
            out.append((np.array([-1, -1]), np.zeros(2, int), np.arange(2), np.zeros(2, int), errors[:, 1].astype(int), errors[:, 0]))
        arrays = [pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.float64()], strict=True)]
        yield pa.record_batch(arrays, ["leaf", "col", "bin", "g", "n", "e"])

    def split(key, t):
        if key[0].as_py() < 0:
            rows = sorted(zip(t["bin"].to_pylist(), t["n"].to_pylist(), t["e"].to_pylist(), strict=True))
            return pa.table({"leaf": [-1] * len(rows), "col": [r[0] for r in rows], "gain": [r[2] for r in rows], "bins": [[r[1]] for r in rows], "default_left": [False] * len(rows), "g": [0.0] * len(rows), "n": [0] * len(rows), "all_g": [0.0] * len(rows), "all_n": [0] * len(rows)}, found)
        col, bin_, g, n = (t[c].to_numpy() for c in ("col", "bin", "g", "n"))
        best = None
        for c in np.unique(col):
            hist = np.zeros((2, sizes[c]))
            hist[:, bin_[col == c]] = g[col == c] * unit, n[col == c]
            one = best_split(hist[0, :-1], hist[1, :-1], (hist[0, -1], hist[1, -1]), s, int(c) in cats)
            if one and (best is None or one[0] > best[1][0]):
                best = (int(c), one)
        first = col == col.min()
        every = float((g[first] * unit).sum()), int(n[first].sum())
        c, (gain, bins, left, lg, ln) = best or (-1, (0.0, np.zeros(0, int), False, 0.0, 0))
        return pa.table({"leaf": [key[0].as_py()], "col": [c], "gain": [gain], "bins": [bins.tolist()], "default_left": [left], "g": [lg], "n": [ln], "all_g": [every[0]], "all_n": [every[1]]}, found)

    found = pa.schema([("leaf", pa.int64()), ("col", pa.int64()), ("gain", pa.float64()), ("bins", pa.list_(pa.int64())), ("default_left", pa.bool_()), ("g", pa.float64()), ("n", pa.int64()), ("all_g", pa.float64()), ("all_n", pa.int64())])
    sums = blocks.mapInArrow(add, "leaf long, col long, bin long, g long, n long, e double").groupBy("leaf", "col", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "n", "e")])
    got = sums.groupBy("leaf").applyInArrow(split, "leaf long, col long, gain double, bins array<long>, default_left boolean, g double, n long, all_g double, all_n long").collect()
    state.unpersist()
    errors = {r["col"]: (r["gain"], r["bins"][0]) for r in got if r["leaf"] < 0}
    return {r["leaf"]: r for r in got if r["leaf"] >= 0}, errors


def _grow(blocks: DataFrame, trees: list[Tree], number: int, sizes: list[int], cats: set[int], unit: float, s: BoostSettings):
    """One tree, grown from its best leaves, and the errors before it."""
    rng = np.random.default_rng([s.seed, number])
    used = sorted(rng.choice(len(sizes), max(1, math.ceil(s.col_share * len(sizes))), replace=False).tolist()) if sizes else []
    value = lambda g, n: float(-s.rate * soft(g, s.l1) / (n + s.l2))
    tree, errors, open_ = Tree([[-1, None, False, -1, -1, 0.0, 0.0, 0]]), {}, [0]
    best: dict[int, dict] = {}
    while open_:
        found, seen = _wave(blocks, trees, tree, open_, used, sizes, number, cats, unit, s)
        errors = errors or seen
        best |= {k: r for k, r in found.items() if r["col"] >= 0}
        if 0 in found and open_ == [0]:
            tree.nodes[0][5], tree.nodes[0][7] = value(found[0]["all_g"], found[0]["all_n"]), found[0]["all_n"]
        room = s.leaves - sum(x[3] < 0 for x in tree.nodes)
        # The best leaves first. A wave splits half of the room at most, so that later, better leaves find some.
        chosen = sorted(best, key=lambda k: (-best[k]["gain"], k))[: max(1, room // 2) if room > 0 else 0]
        open_ = []
        for k in chosen:
            r = best.pop(k)
            mask = np.zeros(sizes[r["col"]], bool)
            mask[r["bins"]] = True
            mask[-1] = r["default_left"]
            left, right = len(tree.nodes), len(tree.nodes) + 1
            tree.nodes[k][:5] = [r["col"], mask, r["default_left"], left, right]
            tree.nodes[k][6] = r["gain"]
            for g, n in ((r["g"], r["n"]), (r["all_g"] - r["g"], r["all_n"] - r["n"])):
                tree.nodes.append([-1, None, False, -1, -1, value(g, n), 0.0, n])
            open_ += [left, right]
        if sum(x[3] < 0 for x in tree.nodes) >= s.leaves:
            break
    return tree, errors


def fit(
    rows: DataFrame,
    cols: Sequence[str],
    label: str,
    validation: str | None = None,
    categorical: Sequence[str] = (),
    settings: BoostSettings = BoostSettings(),
    borders: dict[str, list[float]] | None = None,
    model_id: int = 1,
) -> Booster:
    """Boosted trees of at most ``leaves`` leaves each.

    Leaf weights are shrunk by l1 and l2. ``validation`` names a boolean column; its true rows only decide, with ``patience``, which
    round is the best; later trees are dropped. Without it all rounds count. Missing inputs go the way that gained more in
    training, categories that training doesn't hold to the right. ``borders`` may name the bins' upper borders; otherwise they are quantiles.
    Rows without a label take no part. No rows at all: a single leaf of 0.
    """
    s, spark, cats = settings, rows.sparkSession, set(categorical)
    rows = rows.where(F.col(label).isNotNull())
    train = rows if validation is None else rows.where(~F.col(validation))
    mean, spread = train.agg(F.avg(label), F.max(F.abs(F.col(label)))).first()
    base, unit = float(mean or 0.0), max(float(spread or 0.0), 1e-300) * 2.0**-30
    if mean is None:
        return Booster(_node_rows([], cols, {}, {}, 0.0, model_id), [], list(cols))
    levels = {c: sorted(float(r[0]) for r in train.where(F.col(c).isNotNull()).select(F.col(c).cast("double")).distinct().collect()) for c in cats}  # one value a category
    real = [c for c in cols if c not in cats]
    edges = {c: sorted(b) for c, b in (borders or {}).items()} | (borders_of(train, [c for c in real if c not in (borders or {})], s.bins) if set(real) - set(borders or {}) else {})
    sizes = [len(levels[c] if c in cats else edges[c]) + 2 for c in cols]
    blocks = _binned(rows, cols, edges, levels, label, validation, base)
    trees, kept, history, best = [], [], [], (math.inf, 0)
    places = {i for i, c in enumerate(cols) if c in cats}
    rmse = lambda e: math.sqrt(e[0] / e[1]) if e and e[1] else math.nan

    def note(errors: dict, rounds: int) -> bool:
        """Keep the errors after ``rounds`` rounds; whether to go on."""
        nonlocal best
        train_, valid = rmse(errors.get(0)), rmse(errors.get(1))
        history.append((model_id, rounds, train_, valid))
        if validation is None or valid < best[0] or math.isnan(valid):
            best = (valid, rounds)
        return rounds - best[1] < s.patience

    for number in range(s.rounds):
        tree, errors = _grow(blocks, kept, number, sizes, places, unit, s)
        if not note(errors, number):
            break
        trees.append(tree)
        kept.append(tree)
        if len(kept) >= KEEP:
            blocks, kept = _advance(blocks, kept, len(sizes)), []
        if number + 1 == s.rounds:  # the errors after the last round
            note(_wave(blocks, kept, Tree([[-1, None, False, -1, -1, 0.0, 0.0, 0]]), [0], [], sizes, s.rounds, places, unit, s)[1], s.rounds)
    return Booster(_node_rows(trees[: best[1]], cols, edges, levels, base, model_id), [(*h, h[1] == best[1]) for h in history], list(cols))


def _advance(blocks: DataFrame, trees: list[Tree], cols: int) -> DataFrame:
    state = blocks.sparkSession.sparkContext.broadcast([t.nodes for t in trees])

    def add(batches):
        done = [Tree(nodes) for nodes in state.value]
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                codes, _, _, _, score = _unpack(row, cols)
                row["score"] = (score + sum(t.value(codes) for t in done)).tobytes()
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return stage(blocks.mapInArrow(add, BLOCK_SCHEMA), "boost-rows")


def _node_rows(trees: list[Tree], cols: Sequence[str], edges: dict, levels: dict, base: float, model_id: int) -> list[tuple]:
    """The trees as rows that any scorer of stored ensembles reads; the first tree is the mean."""
    out = [(model_id, 0, 0, None, None, None, None, None, base, None, None, None)]
    for number, tree in enumerate(trees, 1):
        for k, (col, mask, default_left, left, right, value, gain, n) in enumerate(tree.nodes):
            if left < 0:
                out.append((model_id, number, k, None, None, None, None, None, value, None, None, n))
                continue
            name = cols[col]
            if name in levels:
                cut, named = None, [v for v, go in zip(levels[name], mask[:-2], strict=True) if go]
            else:
                cut, named = edges[name][int(mask[:-1].sum()) - 1], None
            out.append((model_id, number, k, name, cut, bool(default_left), left, right, None, named, gain, n))
    return out
