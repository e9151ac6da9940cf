"""Exact n-gram Jaccard join of whole texts through an index of count vectors.

The distinct shingles of a document are hashed into groups; the counts of the groups are a point. Two sets share at most the
sum over all groups of the smaller count, so a pair can only link if that sum reaches the overlap its sizes ask for. Points
are bulk-loaded into tiles (size first, then counts), a tile into nodes; tiles, nodes and points that the bound rules out are
never compared. What the bound lets through is connected to classes, and inside a class the sets themselves decide.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolis.llm.common import bound_batches, mix64, ranked, stage, text_slices, without

#: Groups of the coarse vector, kept for every document; the fine one has a power of two that grows with the set.
COARSE, FINEST = 16, 1 << 14
#: Points in a node.
NODE = 64
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str, k: int, seen: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; fewer words make one shingle, no word none.

    Words are hashed once per task (``seen``) and combined by position. Two different shingles meet with odds of 2^-64.
    """
    words = WORDS.findall(text.lower() if text.isascii() else text.translate(_UPPER))
    if not words:
        return np.empty(0, np.uint64)
    for w in [w for w in set(words) if w not in seen]:
        seen[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def tightness(percent: int) -> float:
    """Largest share of two sets' sizes by which they may differ: 2 * (1 - t) / (1 + t) of the mean size."""
    return 2 * (100 - percent) / (100 + percent)


def groups_of(n: int, percent: int) -> int:
    """Groups enough that unrelated sets differ by about three times what a link allows (differences grow as sqrt(n * groups))."""
    g = (3 * tightness(percent) / 1.13) ** 2 * n
    return int(min(FINEST, max(COARSE, 1 << int(np.ceil(np.log2(max(1.0, g)))))))


def level(n: int, percent: int) -> int:
    """Groups by which all pairs of two nodes are compared at first: unrelated sets differ by half more than a link allows."""
    return max(COARSE, 1 << int(np.ceil(np.log2(max(1.0, 2 * tightness(percent) ** 2 * n)))))


def fold_to(points: np.ndarray, groups: int) -> np.ndarray:
    """Counts of fewer groups: a power of two divides the finer numbering."""
    return points.reshape(len(points), -1, groups).sum(axis=1) if points.shape[1] != groups else points


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Common shingles that sets of these sizes need: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def describe_sets(rows: DataFrame, k: int, percent: int, tokens: bool) -> DataFrame:
    """doc_id and digest of every row with its set: either n, set_id (128 bits that name the set) and point, or the tokens."""

    def build(batches):
        seen: dict[str, int] = {}
        for batch in text_slices(batches, "text"):
            out = []
            for text in batch["text"].to_pylist():
                if len(seen) > 500_000:
                    seen = {}
                s = shingles(text, k, seen)
                if tokens:
                    out.append((s.astype("<u8").tobytes(),))
                    continue
                groups = groups_of(len(s), percent)
                point = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u2" if len(s) < 1 << 16 else "<u4")
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), point.tobytes()))
            kinds = [pa.binary()] if tokens else [pa.int64(), pa.binary(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.record_batch([batch["doc_id"], batch["digest"], *cols], ["doc_id", "digest", *names])

    names = ["tokens"] if tokens else ["n", "set_id", "point"]
    return rows.select("doc_id", "digest", "text").mapInArrow(build, "doc_id long, digest string, " + ("tokens binary" if tokens else "n long, set_id binary, point binary"))


class Points:
    """Points of different fineness, folded to a common number of groups on demand."""

    def __init__(self, column: pa.ChunkedArray, sizes: np.ndarray):
        raw = [np.frombuffer(b, "<u2" if n < 1 << 16 else "<u4").astype(np.int32) for b, n in zip(column.to_pylist(), sizes, strict=True)]
        self.width = np.array([len(r) for r in raw], np.int64)
        self.row = np.zeros(len(raw), np.int64)  # place among the points of the same width
        self.by: dict[int, np.ndarray] = {}
        for w in np.unique(self.width):
            of = np.flatnonzero(self.width == w)
            self.row[of] = np.arange(len(of))
            self.by[int(w)] = np.stack([raw[i] for i in of])

    def take(self, at: np.ndarray, groups: int) -> np.ndarray:
        out = np.empty((len(at), groups), np.int32)
        for w in np.unique(self.width[at]):
            here = self.width[at] == w
            out[here] = fold_to(self.by[int(w)][self.row[at[here]]], groups)
        return out


def connect(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the trees of x[i] and y[i]; ``up`` holds every element's root before and after, the smallest of its tree."""
    while len(x):
        a, b = up[x], up[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up[:] = up[up]


def bound_classes(sizes: np.ndarray, points: Points, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Roots of the classes that pairs of ``left`` and ``right`` form whose summed minima reach the overlap they need.

    Nodes of points are compared by their largest counts, then points, first by a fold of their vectors, then by the fine ones. Pairs
    that are in one class already are passed over. ``left`` and ``right`` are the same positions, or positions of two tiles.
    """
    same, up = np.array_equal(left, right), np.arange(len(sizes))
    coarse = points.take(np.arange(len(sizes)), COARSE)

    def nodes(rows):
        slab = rows[np.argsort(sizes[rows], kind="stable")]
        spread = np.var(coarse[rows] / np.maximum(sizes[rows], 1)[:, None], axis=0).argmax()
        slabs = [slab[i : i + 16 * NODE] for i in range(0, len(slab), 16 * NODE)]
        cuts = [c[i : i + NODE] for s in slabs for c in [s[np.argsort(coarse[s, spread], kind="stable")]] for i in range(0, len(c), NODE)]
        return cuts, np.array([sizes[c].min() for c in cuts]), np.array([sizes[c].max() for c in cuts]), np.stack([coarse[c].max(axis=0) for c in cuts])

    ca, la, ha, ma = nodes(left)
    cb, lb, hb, mb = (ca, la, ha, ma) if same else nodes(right)
    for i, rows in enumerate(ca):
        most = np.minimum(np.minimum(ma[i], mb).sum(axis=1), np.minimum(ha[i], hb))
        ok = np.flatnonzero(most >= least_overlap(la[i], lb, percent))
        ok = ok[ok >= i] if same else ok
        for at in range(0, len(ok), 64):
            others = np.concatenate([cb[j] for j in ok[at : at + 64]])
            need = least_overlap(sizes[rows][:, None], sizes[others][None, :], percent).astype(np.int32)
            groups = int(min(level(la[i], percent), points.width[rows].min(), points.width[others].min()))
            kind = np.int16 if max(ha[i], hb[ok].max()) < 1 << 15 else np.int32
            p, q = (np.ascontiguousarray(points.take(z, groups).T.astype(kind)) for z in (rows, others))
            shared = np.zeros((len(rows), len(others)), kind)
            for g in range(groups):
                shared += np.minimum(p[g][:, None], q[g][None, :])
            x, y = np.nonzero((shared >= need) & (up[rows][:, None] != up[others][None, :]))
            x, y = rows[x], others[y]
            fine = np.minimum(points.width[x], points.width[y])
            for g in np.unique(fine):
                of = np.flatnonzero(fine == g)
                step = max(1, (1 << 22) // int(g))
                for k in range(0, len(of), step):
                    p, q = x[of[k : k + step]], y[of[k : k + step]]
                    apart = up[p] != up[q]
                    p, q = p[apart], q[apart]
                    hit = np.minimum(points.take(p, int(g)), points.take(q, int(g))).sum(axis=1) >= least_overlap(sizes[p], sizes[q], percent)
                    connect(up, p[hit], q[hit])
    return up


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections: frequent tokens by a matrix product, rare ones by listing their pairs."""
    flat = np.concatenate([*left, *right]).astype(np.uint64)
    doc = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, token = np.unique(flat, return_inverse=True)
    l, r = doc < len(left), doc >= len(left)
    fl, fr = np.bincount(token[l], minlength=token.max(initial=-1) + 1), np.bincount(token[r], minlength=token.max(initial=-1) + 1)
    out = np.zeros((len(left), len(right)), np.float32)
    often = np.flatnonzero(fl * fr > (len(left) + len(right)) * 4)
    number = np.full(len(fl), -1)
    number[often] = np.arange(len(often))
    for at in range(0, len(often), 2048):
        here = (number[token] >= at) & (number[token] < at + 2048)
        a = np.zeros((len(left), 2048), np.float32)
        b = np.zeros((len(right), 2048), np.float32)
        a[doc[l & here], number[token[l & here]] - at] = 1
        b[doc[r & here] - len(left), number[token[r & here]] - at] = 1
        out += a @ b.T
    rare = (number < 0) & (fl > 0) & (fr > 0)
    order = np.argsort(token[r], kind="stable")
    to, first = doc[r][order] - len(left), np.cumsum(fr) - fr
    mine = np.flatnonzero(l & rare[token])
    for at in range(0, len(mine), 100_000):
        m = mine[at : at + 100_000]
        n = fr[token[m]]
        pos = np.repeat(first[token[m]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        code = np.repeat(doc[m], n) * len(right) + to[pos]
        out += np.bincount(code, minlength=out.size).reshape(out.shape)
    return out.astype(np.int64)


def link_blocks(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the sets of ``left`` and ``right`` that link."""
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    return np.nonzero(overlaps(left, right) >= least_overlap(a[:, None], b[None, :], percent))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the smallest node connected: large-star and small-star rounds.

    A round joins every node with the least of its neighbours; the least comes from an aggregate that combines before the
    shuffle, and the join can split a node with very many neighbours. Every round is a written table.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "jaccard-edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "of")
        large = both.join(least, both.a == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large.where("a <> b"), "jaccard-large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        small = large.join(least, large.a == F.col("of")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.union(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct(), "jaccard-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        mark = now


def tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b), a <= b: tiles whose sizes and largest counts leave room for a link. Tiles meet by bands of sizes."""
    def describe(key, t):
        sizes = t["n"].to_numpy()
        corner = Points(t["point"], sizes).take(np.arange(len(sizes)), COARSE).max(axis=0)
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), "low": [int(sizes.min())], "high": [int(sizes.max())], "corner": pa.array([corner.tolist()], pa.list_(pa.int64()))})

    box = stage(tiles.groupBy("tile").applyInArrow(describe, "tile long, low long, high long, corner array<long>"), "jaccard-tiles")
    band = lambda c: F.floor(F.log(F.col(c).cast("double")) / np.log(100 / percent)).cast("long")
    one = box.select(*(F.col(c).alias(f"{c}_a") for c in box.columns), F.explode(F.sequence(band("low"), band("high"))).alias("band"))
    two = box.select(*(F.col(c).alias(f"{c}_b") for c in box.columns), F.explode(F.sequence(band("low") - 1, band("high") + 1)).alias("band"))
    shared = F.aggregate(F.zip_with("corner_a", "corner_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    need = F.ceil(F.lit(percent) * (F.col("low_a") + F.col("low_b")) / (100 + percent))
    met = one.join(two, "band").where(F.least(shared, "high_a", "high_b") >= need)
    return met.select(F.least("tile_a", "tile_b").alias("a"), F.greatest("tile_a", "tile_b").alias("b")).distinct()


#: Points in a tile, on average; shingles in one block of a class; shingles of small classes that share a task.
TILE, BLOCK_TOKENS, UNIT_TOKENS = 8192, 1 << 18, 1 << 21


def similar_sets(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n, set_id) of every row, and (set_id, min_doc, root) of every set: equal roots are connected by links."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    described = stage(describe_sets(rows, k, percent, tokens=False), "jaccard-rows")
    sets = described.where("n > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("min_doc"), F.min("n").alias("n"), F.min("digest").alias("digest"), F.min("point").alias("point")
    )
    sets = stage(sets.withColumn("sid", F.monotonically_increasing_id()), "jaccard-sets")

    # Smaller sets link with nothing but their like.
    able = sets.where(F.col("n") >= -(-percent // (100 - percent))).select("sid", "n", "point")
    tiles = ranked(able, ["n", "point", "sid"], "jaccard-points").withColumn("tile", F.floor(F.col("rank") / TILE)).drop("rank")
    pairs = stage(tile_pairs(tiles, percent), "jaccard-pairs")
    left = tiles.join(pairs, tiles.tile == pairs.a).withColumn("side", F.lit(0))
    right = tiles.join(pairs.where("a <> b"), F.col("tile") == F.col("b")).withColumn("side", F.lit(1))

    def compare(key, t):
        sizes, side, sid = t["n"].to_numpy(), t["side"].to_numpy(), t["sid"].to_numpy()
        at = np.flatnonzero(side == 0)
        up = bound_classes(sizes, Points(t["point"], sizes), at, np.flatnonzero(side == 1) if side.any() else at, percent)
        own = np.flatnonzero(up != np.arange(len(up)))
        return pa.table({"a": sid[own], "b": sid[up[own]]})

    near = left.unionByName(right).groupBy("a", "b").applyInArrow(compare, "a long, b long")
    classes = stage(components(near).select(F.col("node").alias("sid"), F.col("root").alias("class")), "jaccard-classes")

    # The sets of the classes, built again from one text each; a class too large for one task is dealt to pairs of blocks.
    wanted = stage(classes.join(sets.select("sid", "digest", "n"), "sid"), "jaccard-wanted")
    weight = wanted.groupBy("class").agg(F.sum("n").alias("all"))
    blocks = F.ceil(F.col("all") / BLOCK_TOKENS).cast("int")
    units = -(-(wanted.agg(F.sum("n")).first()[0] or 0) // UNIT_TOKENS) or 1
    dealt = wanted.join(weight, "class").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), blocks).cast("int"))
    dealt = stage(dealt.select("sid", "class", "digest", "blocks", "block"), "jaccard-dealt")
    # Merged at every size: the texts are dealt by digest here and stay so for the aggregate.
    texts = rows.join(dealt.select("digest").distinct().hint("merge"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    built = describe_sets(texts.withColumn("doc_id", F.lit(None).cast("long")), k, percent, tokens=True).select("digest", "tokens")
    built = stage(built, "jaccard-tokens").join(dealt, "digest")
    lone = built.where("blocks = 1").select("sid", "class", "tokens", (-1 - F.pmod(F.xxhash64("class"), F.lit(units))).alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    with_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    many = built.where("blocks > 1").select("*", with_).select(
        "sid", "class", "tokens", F.col("class").alias("unit"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )

    def verify(key, t):
        sid, kind, side = t["sid"].to_numpy(), t["class"].to_numpy(), t["side"].to_numpy()
        sets_ = [np.frombuffer(b, "<u8") for b in t["tokens"].to_pylist()]
        order = np.lexsort((side, kind))
        a, b = [], []
        for of in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
            l = of[side[of] == 0]
            r = of[side[of] == 1] if side[of].any() else l
            x, y = link_blocks([sets_[i] for i in l], [sets_[i] for i in r], percent)
            up = np.arange(len(sid))
            connect(up, l[x], r[y])
            own = of[up[of] != of]
            a.append(sid[own])
            b.append(sid[up[own]])
        none = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    linked = lone.unionByName(many).groupBy("unit", "i", "j").applyInArrow(verify, "a long, b long")
    roots = components(linked)
    joined = sets.select("sid", "set_id", "min_doc").join(roots, F.col("sid") == F.col("node"), "left")
    return described.select("doc_id", "digest", "n", "set_id"), joined.select("set_id", "min_doc", F.coalesce("root", "sid").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """Connected groups of documents whose sets of ``k``-word shingles have a Jaccard similarity of ``percent`` or more.

    Words are runs of characters other than white space (space, tab to carriage return), with A-Z lower-cased. Fewer words than ``k``
    are one shingle. Returns per row doc_id, n_shingles (size of the set) and component_id, the smallest doc_id reachable by
    links, itself included. Rows without words or text link with nothing. Rows without an id take part; a component_id is NULL
    only if no row of the group has an id. Repeated rows and ids are rows like any other. Other columns are left out. An
    empty table gives an empty result.
    """
    rows, sets = similar_sets(docs, k, percent)
    sets = stage(sets, "jaccard-roots")
    groups = sets.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    of = stage(sets.join(groups, "root").select("set_id", "component_id"), "jaccard-groups")
    out = rows.join(of.withColumnRenamed("set_id", "of"), (F.col("set_id") == F.col("of")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each connected group: the smallest doc_id (rows with an id first), then the smallest md5 of the text.

    Rows without words or text are no group and stay; rows alike in id and text are one document. All columns are kept.
    """
    key = lambda: F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows, sets = similar_sets(docs, k, percent)
    sets = stage(sets.select(F.col("set_id").alias("of"), "root"), "jaccard-roots")
    named = rows.join(sets, (F.col("set_id") == F.col("of")) & (F.col("n") > 0), "left")
    first = named.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("m"))
    kept = first.select("m.doc_id", "m.digest").union(named.where("n = 0").select("doc_id", "digest").distinct())
    kept = stage(kept.select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")), "jaccard-kept")
    # Combined before the shuffle, so that a row repeated very often travels once from each task; the join needs no other shuffle.
    own = without(docs, ["_kept_id", "_kept_digest", "_own_id", "_own_digest"])
    once = own.withColumn("_own_id", F.col("doc_id").cast("long")).withColumn("_own_digest", key()).dropDuplicates(["_own_id", "_own_digest"])
    same = F.col("_own_id").eqNullSafe(F.col("_kept_id")) & (F.col("_own_digest") == F.col("_kept_digest"))
    return once.join(kept, same, "left_semi").select(own.columns)


def oracle(k: int = 3, percent: int = 90) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
g AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i
      FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * i >= {percent} * (nx + ny - i)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.other = b.x)
SELECT g.doc_id, len(g.g) AS n_shingles, m.c AS component_id FROM g JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) m ON g.doc_id = m.doc_id"""
