"""Hard negatives by threshold joins over inverted indexes whose entries and partial scores are bounded by norms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeolis.llm.common import ranked, stage
from aeolis.llm.topk import matrix

#: Rows of a block of candidates and of a block of anchors; anchors scored at once; axes of one step of the accumulation.
BLOCK, ANCHORS, SLICE, STEP = 8192, 1024, 256, 16
#: Thresholds, in hundredths of the positive's score, at which a window that isn't full yet is searched again.
LOWER = (75, 50)
EXACT = 2.0**53


class Index:
    """Inverted index of a block's vectors for inner products of at least ``least`` with queries of length one.

    Axes are taken in ascending order of what they hold. A vector's first axes, as long as their norm stays below ``least``, are
    left out: a vector with nothing else can't reach the threshold. Of the rest, every step of axes lists the vectors that have
    an entry there.
    """

    def __init__(self, x: np.ndarray, least: float):
        self.order = np.argsort((x * x).sum(axis=0), kind="stable")
        self.x = x[:, self.order]
        #: Norms of the first 0, 1, 2, ... axes of each vector.
        self.norms = np.sqrt(np.hstack([np.zeros((len(x), 1)), np.cumsum(self.x * self.x, axis=1)]))
        #: First indexed axis: the one with which the norm may reach the threshold.
        self.start = (self.norms[:, 1:] * (1 + 1e-9) < least).sum(axis=1) if least > 0 else np.zeros(len(x), np.int64)

    def search(self, q: np.ndarray, least: np.ndarray):
        """(query, row) of every pair whose inner product may reach the query's threshold, and the product itself, as doubles.

        Steps are accumulated from the fullest axes down; after each, pairs whose partial score and remaining norms stay
        below the threshold end, and rows without a pair are dropped from the postings of the next step.
        """
        dim = q.shape[1]
        q = q[:, self.order]
        rest = np.sqrt(np.hstack([np.zeros((len(q), 1)), np.cumsum(q * q, axis=1)]))
        live = np.flatnonzero(self.start < dim) if dim else np.arange(len(self.x))
        slack = 1e-9 * (rest[:, -1:] * self.norms[:, -1].max(initial=0) + 1)
        acc = np.zeros((len(q), len(live)))
        alive = np.ones(acc.shape, bool)
        for end in range(dim, 0, -STEP):
            low = max(0, end - STEP)
            has = self.start[live] < end
            part = self.x[live[has], low:end] * (np.arange(low, end) >= self.start[live[has]][:, None])
            acc[:, has] += q[:, low:end] @ part.T
            below = np.maximum(low, self.start[live])
            bound = rest[:, below] * self.norms[live, below]
            alive &= acc + bound >= least[:, None] - slack
            keep = alive.any(axis=0)
            live, acc, alive = live[keep], acc[:, keep], alive[:, keep]
        i, j = np.nonzero(alive)
        rows, out = live[j], acc[i, j]
        for at in range(0, len(i), 1 << 16):  # the axes left out of the index
            a, b = i[at : at + (1 << 16)], rows[at : at + (1 << 16)]
            first = np.arange(dim) < self.start[b][:, None]
            out[at : at + (1 << 16)] += (q[a] * self.x[b] * first).sum(axis=1)
        return i, rows, out


def over(q: np.ndarray, x: np.ndarray, least: np.ndarray):
    """(i, j, score) of all pairs whose exact score is at least ``least[i]``; scores are whole numbers, of any length beyond 2^53."""
    size = np.sqrt((q * q).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        per = np.where(size > 0, least / size, np.where(least > 0, np.inf, -np.inf))
    out = []
    order = np.argsort(per, kind="stable")  # anchors of like thresholds share an index
    largest = float(np.sqrt((x * x).sum(axis=1)).max(initial=0))
    for at in range(0, len(q), SLICE):
        part = order[at : at + SLICE]
        i, j, s = Index(x, float(per[part].min())).search(q[part], least[part])
        if float(size[part].max(initial=0)) * largest < EXACT:
            s = np.rint(s).astype(np.int64)
        else:
            whole = lambda m, rows: {r: [int(c) for c in m[r]] for r in set(rows.tolist())}
            a, b = whole(q[part], i), whole(x, j)
            s = np.array([sum(c * d for c, d in zip(a[m], b[n], strict=True)) for m, n in zip(i.tolist(), j.tolist(), strict=True)] + [None], object)[:-1]
        ok = s >= least[part][i]
        out.append((part[i][ok], j[ok], s[ok]))
    return [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's ``k`` highest scores, ties to the smaller id, in that order."""
    order = np.lexsort((ids, -score, group)) if len(group) else np.empty(0, np.int64)
    held = group[order]
    return order[np.arange(len(order)) - np.searchsorted(held, held) < k]


# ---------------------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, dim, v) of the rows that take part; v = floor(scale * x) as doubles, whole from 2^53 on by themselves."""
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    v = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    rows = vectors.where(F.col("label").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"), v.alias("v"))


def packed(rows: DataFrame) -> DataFrame:
    """One row a block: its labels' range, largest norm, and its rows as bytes of the narrowest kind that holds them."""

    def pack(key, t):
        x = matrix(t["v"], key[0].as_py())
        large = np.abs(x).max(initial=0)
        kind = "<i2" if large < 2**15 else "<i4" if large < 2**31 else "<f8"
        known = t["vec_id"].is_valid().to_numpy()
        label = t["label"].to_numpy()
        row = {
            "dim": key[0].as_py(), "blk": key[1].as_py(), "low": int(label.min()), "high": int(label.max()), "norm": float(np.sqrt((x * x).sum(axis=1)).max()),
            "kind": kind, "x": x.astype(kind).tobytes(), "ids": t["vec_id"].fill_null(0).to_numpy().tobytes(), "known": known.tobytes(),
            "labels": label.tobytes(), "places": t["rank"].to_numpy().tobytes(),
        }
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema(
        [("dim", pa.int32()), ("blk", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("norm", pa.float64()), ("kind", pa.string())]
        + [(c, pa.binary()) for c in ("x", "ids", "known", "labels", "places")]
    )
    kinds = "dim int, blk long, low long, high long, norm double, kind string, x binary, ids binary, known binary, labels binary, places binary"
    return rows.groupBy("dim", "blk").applyInArrow(pack, kinds)


def unpacked(block: pa.Table) -> dict[str, np.ndarray]:
    b = block.to_pylist()[0]
    ids, known = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["known"], bool)
    return {
        "x": np.frombuffer(b["x"], b["kind"]).reshape(len(ids), b["dim"]).astype(np.float64),
        "ids": ids, "known": known, "label": np.frombuffer(b["labels"], np.int64), "place": np.frombuffer(b["places"], np.int64),
        "order": np.where(known, ids, np.iinfo(np.int64).max),  # rows without an id come last among ties
    }


def _positives(k: int):
    """Each anchor's best rows of its own label in a block, of those that reach the anchor's threshold."""

    def find(key, here, block):
        if not len(here) or not len(block):
            return pa.Table.from_pylist([], out)
        b, place, label = unpacked(block), here["rank"].to_numpy(), here["label"].to_numpy()
        least = here["least"].fill_null(-np.inf).to_numpy()
        found = []
        for of in np.unique(label):  # a block holds few labels, or few rows of each
            a, c = np.flatnonzero(label == of), np.flatnonzero(b["label"] == of)
            i, j, s = over(matrix(here["v"].take(pa.array(a)), key[0].as_py()), b["x"][c], least[a])
            i, j = a[i], c[j]
            other = place[i] != b["place"][j]
            i, j, s = i[other], j[other], s[other]
            best = first(i, s, b["order"][j], k)
            found.append((place[i[best]], j[best], s[best]))
        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
        ids = pa.array(b["ids"][j], mask=~b["known"][j])
        return pa.table([pa.array([key[0].as_py()] * len(i), pa.int32()), pa.array(i, pa.int64()), ids, pa.array(s, pa.int64())], out)

    out = pa.schema([("dim", pa.int32()), ("rank", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    return find, "dim int, rank long, vec_id long, score long"


def _negatives(k: int, low: int, high: int):
    """Each window's best rows of other labels in a block, of those that reach the window's threshold (in hundredths of the positive)."""

    def find(key, here, block):
        if not len(here) or not len(block):
            return pa.Table.from_pylist([], out)
        b, place, label = unpacked(block), here["rank"].to_numpy(), here["label"].to_numpy()
        q, found = matrix(here["v"], key[0].as_py()), []
        windows = here["windows"].to_pylist()
        # Thresholds are compared exactly below; here a little lower, as doubles round.
        least = np.array([min(w["part"] * w["score"] / 100 for w in ws) for ws in windows])
        i, j, s = over(q, b["x"], least - np.abs(least) * 1e-12)
        other = label[i] != b["label"][j]
        i, j, s = i[other], j[other], s[other]
        order = np.argsort(i, kind="stable")
        i, j, s = i[order], j[order], s[order]
        ends = np.searchsorted(i, np.arange(len(windows) + 1))
        for a, ws in enumerate(windows):
            at = slice(ends[a], ends[a + 1])
            big = s[at].astype(object) if len(s[at]) and max(abs(int(s[at].max())), abs(int(s[at].min()))) > 1 << 55 else s[at]
            for w in ws:
                mine = np.flatnonzero((100 * big >= w["part"] * w["score"]) & (100 * big <= high * w["score"]))
                best = mine[first(np.zeros(len(mine), np.int64), s[at][mine], b["order"][j[at][mine]], k)]
                found.append((np.full(len(best), place[a]), np.full(len(best), w["nth"]), j[at][best], s[at][best]))
        p, nth, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
        ids = pa.array(b["ids"][j], mask=~b["known"][j])
        return pa.table([pa.array([key[0].as_py()] * len(p), pa.int32()), pa.array(p, pa.int64()), pa.array(nth, pa.int32()), ids, pa.array(s, pa.int64())], out)

    out = pa.schema([("dim", pa.int32()), ("rank", pa.int64()), ("nth", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    return find, "dim int, rank long, nth int, vec_id long, score long"


def meet(asked: DataFrame, blocks: DataFrame, f) -> DataFrame:
    """Run ``f`` for each (anchor block ab, candidate block blk) that occurs in ``asked``."""
    find, schema = f
    there = asked.select("dim", "ab", "blk").distinct().join(blocks, ["dim", "blk"])
    there = there.select([F.col(c).alias(c) for c in there.columns])  # both sides stem from one table
    return asked.groupBy("dim", "ab", "blk").cogroup(there.groupBy("dim", "ab", "blk")).applyInArrow(find, schema)


def best(found: DataFrame, k: int, name: str, keys: tuple[str, ...]) -> DataFrame:
    """The first ``k`` of what the blocks returned, with their place."""
    top = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn(name, F.row_number().over(top)).where(F.col(name) <= k)


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK, anchors: int = ANCHORS
) -> DataFrame:
    """For each anchor and each of its ``positives``, the ``negatives`` hardest rows of another label.

    Components become floor(scale * x), scores are integer inner products, higher first, ties to the smaller vec_id. Anchors are the
    rows whose vec_id is divisible by ``every``; an anchor's positives are its first other rows of the same label; a positive's
    negatives are the first rows of another label whose score lies within ``low`` and ``high`` hundredths of the positive's.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows are sorted by label into blocks. A block pair is a threshold join over an inverted index of the block. Positives: an
    anchor's own block gives it a threshold (the k-th score there, none if there are fewer), with which it meets the other blocks
    of its label. Negatives: one block gives each window a threshold; windows that it doesn't fill start at 75 hundredths
    of the positive's score and go on to 50 and to ``low`` until they are full. Blocks that no threshold can reach are skipped.

    Rows with a NULL label, a NULL vector or NULL or non-finite components take no part. Each row counts, repeated ids and
    repeated rows, too: an anchor is no candidate of its own, but its copies are. Rows without an id are no anchors and come last among
    ties. Vectors of different lengths are no candidates for each other. A positive below 0 has no negatives. Other columns are left
    out. Scores beyond 2^63 end the query with an error. An empty table gives an empty result.
    """
    rows = usable(vectors, scale).withColumn("h", F.xxhash64("vec_id")).withColumn("row", F.monotonically_increasing_id())
    rows = ranked(rows, ["dim", "label", "h", "vec_id", "row"], "negatives-rows", within=("dim",)).drop("h", "row")
    rows = rows.withColumn("blk", F.expr(f"rank div {block}"))
    blocks = stage(packed(rows), "negatives-blocks")
    chosen = rows.where(F.col("vec_id") % every == 0).select("dim", "label", "vec_id", "v", F.col("rank").alias("place"), "blk")
    chosen = ranked(chosen, ["dim", "label", "place"], "negatives-anchors", within=("dim",)).withColumn("ab", F.expr(f"rank div {anchors}"))
    chosen = stage(chosen.select("dim", "label", "vec_id", "v", F.col("place").alias("rank"), "blk", "ab"), "negatives-asked")

    # Positives: the own block first, then the other blocks that hold the label.
    asked = chosen.drop("vec_id").withColumn("least", F.lit(None).cast("double"))
    probe = stage(best(meet(asked, blocks, _positives(positives)), positives, "nth", ("dim", "rank")), "negatives-near")
    kth = probe.where(F.col("nth") == positives).select("dim", "rank", F.col("score").cast("double").alias("least"))
    spans = rows.groupBy("dim", "label").agg(F.min("blk").alias("first"), F.max("blk").alias("last"))
    # A threshold as a double: a little lower, so that it holds every tie.
    others = chosen.drop("vec_id").join(kth, ["dim", "rank"], "left").withColumn("least", F.col("least") - F.abs("least") * 1e-12)
    others = others.join(spans, ["dim", "label"]).withColumn("own", F.col("blk")).withColumn("blk", F.explode(F.sequence("first", "last"))).where("blk <> own")
    near = meet(others.drop("own", "first", "last"), blocks, _positives(positives))
    pairs = best(probe.drop("nth").unionByName(near), positives, "nth", ("dim", "rank"))
    pairs = stage(pairs.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), "negatives-positives")

    # Negatives: windows that are full or have been searched down to their floor leave the loop.
    count = blocks.groupBy("dim").agg(F.count("*").alias("blks"))
    reach = blocks.select("dim", "blk", F.col("low").alias("lowest"), F.col("high").alias("highest"), F.col("norm").alias("longest"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    open_ = pairs.where("positive_score >= 0").select("dim", "rank", "nth", F.col("positive_score").alias("score"), F.lit(low).alias("part"))
    find, done = _negatives(negatives, low, high), None

    def asking(windows: DataFrame) -> DataFrame:
        held = windows.groupBy("dim", "rank").agg(F.collect_list(F.struct("nth", "score", "part")).alias("windows"))  # at most ``positives``
        return chosen.drop("vec_id").join(held, ["dim", "rank"])

    other = asking(open_).join(count, ["dim"]).withColumn("blk", (F.col("blk") + F.expr("blks div 2")) % F.col("blks")).drop("blks")
    probe = stage(best(meet(other, blocks, find), negatives, "at", ("dim", "rank", "nth")), "negatives-probe")
    kth = probe.where(F.col("at") == negatives).select("dim", "rank", "nth", F.col("score").alias("kth"))
    # The k-th score of one block as hundredths of the positive, rounded down; windows not full there start at the first step.
    share = F.when(F.col("score") > 0, F.floor(F.col("kth") * 100.0 / F.col("score") * (1 - 1e-12)).cast("int"))
    open_ = open_.join(kth, ["dim", "rank", "nth"], "left").withColumn("part", F.greatest(F.lit(low), F.coalesce(share, F.lit(max(low, LOWER[0]))))).drop("kth")
    open_ = stage(open_, "negatives-windows")
    while not open_.isEmpty():
        asked = asking(open_)
        least = F.array_min(F.transform("windows", lambda w: w["part"] * w["score"].cast("double"))) / 100
        asked = asked.withColumn("least", least - F.abs(least) * 1e-12).withColumn("size", size).drop("blk").join(reach, "dim")
        can = (F.col("size") * F.col("longest") * (1 + 1e-9) >= F.col("least")) & ~((F.col("lowest") == F.col("label")) & (F.col("highest") == F.col("label")))
        asked = asked.where(can).drop("lowest", "highest", "longest", "size", "least")
        got = stage(best(meet(asked, blocks, find), negatives, "at", ("dim", "rank", "nth")), "negatives-found")
        full = got.where(F.col("at") == negatives).select("dim", "rank", "nth", F.lit(True).alias("full"))
        state = open_.join(full, ["dim", "rank", "nth"], "left").withColumn("ends", F.col("full") | (F.col("part") <= low))
        state = stage(state.withColumn("ends", F.coalesce("ends", F.lit(False))), "negatives-state")
        ended = got.join(state.where("ends").select("dim", "rank", "nth"), ["dim", "rank", "nth"])
        done = ended if done is None else done.unionByName(ended)
        lower = F.lit(low)
        for step in reversed(LOWER):
            lower = F.when(F.col("part") > step, F.lit(max(low, step))).otherwise(lower)
        open_ = stage(state.where("not ends").select("dim", "rank", "nth", "score", lower.alias("part")), "negatives-windows")
    names = chosen.select("dim", "rank", F.col("vec_id").alias("anchor_id"))
    if done is None:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], empty)
    out = done.join(pairs, ["dim", "rank", "nth"]).join(names, ["dim", "rank"])
    return out.select("anchor_id", "positive_id", F.col("at").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The contract's labels: where vec_id is divisible by 7, (label + 1) % 10."""
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    return vectors.select("vec_id", "embedding", F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def oracle(positives: int = 5, negatives: int = 10, every: int = 100, low: int = 30, high: int = 90, scale: int = 256) -> str:
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label AS alabel, c.rid AS crid, c.vec_id, c.label, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM e a JOIN e c ON a.rid <> c.rid AND len(a.v) = len(c.v) WHERE a.vec_id % {every} = 0),
p AS (SELECT arid, anchor_id, alabel, crid, vec_id AS positive_id, score AS positive_score FROM s WHERE label = alabel
      QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST) <= {positives}),
n AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.arid, p.crid ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
             s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM p JOIN s ON s.arid = p.arid AND s.label <> p.alabel
      WHERE {low} * p.positive_score <= 100 * s.score AND 100 * s.score <= {high} * p.positive_score)
SELECT * FROM n WHERE rank <= {negatives}"""
