"""Merkle manifest of a table: trees of SHA-256 digests in aligned blocks, each block in van Emde Boas order."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolis.llm.common import fold, ranked, stage

#: Children of a node; levels of inner nodes above the lowest level of a block.
FAN, HEIGHT = 8, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# ---------------------------------------------------------------------------------------------------------------------
# Address arithmetic. A block of ``levels`` levels is cut at half its height: the upper part lies first, then the parts
# below it from left to right, each laid out in the same way. No address is stored.


def cells(levels: int) -> int:
    """Cells of a complete block."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index):
    """Cell of the node ``index`` (a number or an array) of the level ``depth`` below a block's root."""
    if levels == 1:
        return index * 0
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    width = FAN ** (depth - upper)
    return cells(upper) + index // width * cells(levels - upper) + address(levels - upper, depth - upper, index % width)


def digest(children: bytes) -> bytes:
    """The node over the digests of its children, which are concatenated as hex text."""
    return sha256(children.hex().encode()).digest()


def needed(n: int) -> int:
    """Levels, the lowest included, until one of ``n`` nodes remains."""
    levels = 1
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def build(leaves: list[bytes], levels: int) -> np.ndarray:
    """A block over ``leaves``: its cells as rows of 32 bytes; the last run of a level may be short, even a single node."""
    out, level = np.zeros((cells(levels), 32), np.uint8), leaves
    for depth in range(levels - 1, -1, -1):
        out[address(levels, depth, np.arange(len(level)))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
        joined = b"".join(level)
        level = [digest(joined[at : at + 32 * FAN]) for at in range(0, len(joined), 32 * FAN)]
    return out


def siblings(block: np.ndarray, levels: int, n: int, index: int) -> bytes:
    """The other nodes of each run on the way from leaf ``index`` of ``n`` to the block's root, from left to right."""
    out = []
    for depth in range(levels - 1, 0, -1):
        first = index // FAN * FAN
        run = np.arange(first, min(first + FAN, n))
        out.append(block[address(levels, depth, run[run != index])].tobytes())
        index, n = index // FAN, -(-n // FAN)
    return b"".join(out)


def climb(node: bytes, path: bytes, index: int, n: int) -> bytes:
    """The root over leaf ``index`` of ``n``, from the leaf's digest and its siblings."""
    at = 0
    while n > 1:
        first = index // FAN * FAN
        left, right = 32 * (index - first), 32 * (min(first + FAN, n) - index - 1)
        node = digest(path[at : at + left] + node + path[at + left : at + left + right])
        at, index, n = at + left + right, index // FAN, -(-n // FAN)
    return node


# ---------------------------------------------------------------------------------------------------------------------
# Trees as tables of blocks. Layer 0 holds the leaves; the roots of a layer's blocks are the leaves of the next one.


def layers(leaves: DataFrame, name: str, height: int = HEIGHT) -> list[DataFrame]:
    """The blocks of one tree for each ``tree``: (tree, block, of, n, size, levels, cells) a layer, from the leaves up.

    ``leaves`` has tree, rank (from 0, without gaps) and digest. A block holds the leaves whose rank has one quotient by 8^height.
    of is the number of the tree's blocks in the layer, n the block's leaves, size the layer's. A tree ends in the layer
    where it has one block.
    """
    width = FAN**height

    def block(key, t):
        order, nth = np.argsort(t["rank"].to_numpy(), kind="stable"), key[1].as_py()
        level = t["digest"].take(pa.array(order)).to_pylist()
        # Only the sole block of a tree has a number of 0 and isn't full.
        levels = needed(len(level)) if nth == 0 and len(level) < width else height + 1
        row = {"tree": key[0].as_py(), "block": nth, "n": len(level), "levels": levels, "cells": build(level, levels).tobytes()}
        return pa.Table.from_pylist([row], kinds)

    kinds = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("levels", pa.int64()), ("cells", pa.binary())])
    out = []
    while True:
        rows = leaves.select("tree", "rank", "digest", F.expr(f"rank div {width}").alias("block"))
        made = stage(rows.groupBy("tree", "block").applyInArrow(block, "tree string, block long, n long, levels long, cells binary"), f"{name}-layer-{len(out)}")
        made = made.join(made.groupBy("tree").agg(F.count("*").alias("of"), F.sum("n").alias("size")), "tree")
        out.append(made)
        more = made.where("of > 1")
        if more.isEmpty():
            return out
        leaves = more.select("tree", F.col("block").alias("rank"), F.substring("cells", 1, 32).alias("digest"))  # the root is cell 0


def roots(made: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    tops = reduce(DataFrame.unionByName, [m.where("of = 1") for m in made])
    return tops.select("tree", F.substring("cells", 1, 32).alias("root"))


def paths(made: list[DataFrame], name: str, height: int = HEIGHT) -> DataFrame:
    """(tree, block, above) of layer 0: the siblings of each block's root on its way to the tree's root.

    From the top layer down: a block of a layer looks its leaves' siblings up by address and puts its own way above behind them.
    """

    def down(batches):
        for b in batches:
            for r in b.to_pylist():
                held = np.frombuffer(r["cells"], np.uint8).reshape(-1, 32)
                # One row a child block, at most 8^height of them.
                ways = [siblings(held, r["levels"], r["n"], i) + r["above"] for i in range(r["n"])]
                first = r["block"] * FAN**height
                yield pa.record_batch(
                    [pa.array([r["tree"]] * len(ways), pa.string()), pa.array(range(first, first + len(ways)), pa.int64()), pa.array(ways, pa.binary())],
                    ["tree", "block", "above"],
                )

    top = lambda m: m.where("of = 1").select("tree", "block", F.lit(b"").alias("above"))
    way = top(made[-1])
    for k in range(len(made) - 1, 0, -1):
        wide = made[k].join(way, ["tree", "block"])
        below = wide.mapInArrow(down, "tree string, block long, above binary")
        way = stage(below.unionByName(top(made[k - 1])), f"{name}-ways-{k}")
    return way


# ---------------------------------------------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """``-`` if NULL, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(F.col(f"`{c}`")) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256))


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The Merkle tree over all documents, a tree for each lang below it, and a check of every document against its proof.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of the siblings, bottom up, left to right), folded_root (from the siblings
    and the leaf, of the text with A-Z lower-cased where 3 divides crc32 of the id) and verified, all digests as hex text.

    Leaves are ranked by a range partition and a sort, never by a window over a language. Tasks build blocks of 8^height leaves;
    proofs are looked up inside the blocks, so that only digests are shuffled.

    NULL values are leaves like any other, of the NULL lang, which comes first, too; rows without an id come first in their
    lang and aren't tampered with. Rows with one id are ordered by their leaf; repeated rows are leaves of their own.
    Empty and very long texts are hashed whole. Other columns are left out. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    tampered = F.when(fold(F.col("doc_id"), 3) == 0, F.translate(text, UPPER, UPPER.lower())).otherwise(text)
    named = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # NULL sorts first, others by their bytes
    rows = docs.select(named.alias("tree"), F.col("doc_id"), leaf(text).alias("digest"), leaf(tampered).alias("met"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    leaves = ranked(rows, ["tree", "doc_id", "digest", "row"], "merkle-leaves", within=("tree",)).drop("row")
    made = layers(leaves, "merkle", height)
    subroots = roots(made).select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("digest"))
    langs = ranked(subroots, ["tree", "lang"], "merkle-langs", within=("tree",))
    return _verified(leaves, made, langs, layers(langs, "merkle-upper", height), height)


def _verified(leaves: DataFrame, made: list[DataFrame], langs: DataFrame, upper: list[DataFrame], height: int) -> DataFrame:
    """Every leaf's row: its siblings by address in its block, behind them those of the block and of its lang, and both folds."""
    width = FAN**height

    def of_lang(key, rows, block):
        """Each lang's place and siblings in the tree of langs."""
        if not len(block):
            return pa.Table.from_pylist([], over)
        b = block.to_pylist()[0]
        held, out = np.frombuffer(b["cells"], np.uint8).reshape(-1, 32), []
        for r in rows.to_pylist():
            own = siblings(held, b["levels"], b["n"], r["rank"] % width)
            out.append({"tree": r["lang"], "subroot": r["digest"], "place": r["rank"], "langs": b["size"], "over": own + b["above"]})
        return pa.Table.from_pylist(out, over)

    over = pa.schema([("tree", pa.string()), ("subroot", pa.binary()), ("place", pa.int64()), ("langs", pa.int64()), ("over", pa.binary())])
    tops = upper[0].join(paths(upper, "merkle-upper", height), ["tree", "block"])
    places = langs.withColumn("block", F.expr(f"rank div {width}")).groupBy("block")
    lang = places.cogroup(tops.groupBy("block")).applyInArrow(of_lang, "tree string, subroot binary, place long, langs long, over binary")
    lang = stage(lang.withColumn("root", roots(upper).select("root").scalar()), "merkle-over")
    blocks = made[0].join(paths(made, "merkle", height), ["tree", "block"]).join(lang, "tree")

    def check(key, rows, block):
        b = block.to_pylist()[0]
        held, out = np.frombuffer(b["cells"], np.uint8).reshape(-1, 32), []
        columns = (rows[c].to_pylist() for c in ("rank", "digest", "met"))
        for rank, own, met in zip(*columns, strict=True):
            way = siblings(held, b["levels"], b["n"], rank % width) + b["above"]
            found = climb(climb(met, way, rank, b["size"]), b["over"], b["place"], b["langs"])
            out.append((own.hex(), b["subroot"].hex(), b["root"].hex(), sha256((way + b["over"]).hex().encode()).hexdigest(), found.hex(), found == b["root"]))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        cols = [pa.array(c, pa.bool_() if n == "verified" else pa.string()) for n, c in zip(names, zip(*out, strict=True), strict=True)]
        return pa.table([rows["doc_id"].combine_chunks(), *cols], ["doc_id", *names])

    dealt = leaves.withColumn("block", F.expr(f"rank div {width}")).groupBy("tree", "block")
    kind = dict(leaves.dtypes)["doc_id"]
    hexes = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    blocks = blocks.repartition("tree", "block")  # else the joins' dealing by tree would do for the groups, too, and a tree fill a task
    return dealt.cogroup(blocks.groupBy("tree", "block")).applyInArrow(check, f"doc_id {kind}, {hexes}, verified boolean")


def _crc32(text: str) -> str:
    """DuckDB: crc32 of a short ASCII text, bit by bit."""
    step = "list_reduce(list_concat([xor(a, b)], [CAST(1 AS BIGINT) FOR i IN range(8)]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"[CAST(ascii(c) AS BIGINT) FOR c IN string_split({text}, '')]"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: {step}), 4294967295)"


def oracle(levels: int = 7, lang_levels: int = 3) -> str:
    """The manifest as a statement for at most 8^levels documents of a lang and 8^lang_levels langs."""
    enc = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    run = f"PARTITION BY tree, pos // {FAN}"
    side = lambda a: f"coalesce(string_agg(h, '') OVER ({run} ORDER BY pos ROWS BETWEEN {a}), '')"
    left, right = side("UNBOUNDED PRECEDING AND 1 PRECEDING"), side("1 FOLLOWING AND UNBOUNDED FOLLOWING")

    def level(name: str, source: str) -> str:
        return f"{name} AS (SELECT tree, pos, h, cnt, {left} AS l, {right} AS r FROM ({source}) s)"

    def above(name: str) -> str:
        node = "CASE WHEN max(cnt) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END"
        return f"SELECT tree, pos // {FAN} AS pos, {node} AS h, (max(cnt) + {FAN - 1}) // {FAN} AS cnt FROM {name} GROUP BY tree, pos // {FAN}"

    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {enc('text')}) AS h, "
        f"sha256({head} || {enc(f'CASE WHEN doc_id IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {lower} ELSE text END')}) AS met FROM documents)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS cnt FROM d)",
        level("a0", "SELECT tree, pos, h, cnt FROM n"),
    ]
    parts += [level(f"a{k}", above(f"a{k - 1}")) for k in range(1, levels + 1)]
    parts += [
        f"t AS (SELECT tree AS lang, '' AS tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS cnt FROM a{levels})",
        level("b0", "SELECT tree, pos, h, cnt FROM t"),
    ]
    parts += [level(f"b{k}", above(f"b{k - 1}")) for k in range(1, lang_levels + 1)]
    joins, sides, met = "", [], "n.met"
    for k in range(levels):
        joins += f" JOIN a{k} ON a{k}.tree = n.tree AND a{k}.pos = n.pos // {FAN**k}"
        sides.append(f"a{k}.l || a{k}.r")
        met = f"CASE WHEN a{k}.cnt = 1 THEN {met} ELSE sha256(a{k}.l || {met} || a{k}.r) END"
    folds = [f"f AS (SELECT n.doc_id, n.tree, n.h AS leaf, {' || '.join(sides)} AS way, {met} AS met FROM n{joins})"]
    joins, over, met = " JOIN t ON t.lang = f.tree", [], "f.met"
    for k in range(lang_levels):
        joins += f" JOIN b{k} ON b{k}.pos = t.pos // {FAN**k}"
        over.append(f"b{k}.l || b{k}.r")
        met = f"CASE WHEN b{k}.cnt = 1 THEN {met} ELSE sha256(b{k}.l || {met} || b{k}.r) END"
    folds.append(
        f"g AS (SELECT f.doc_id, f.leaf, t.h AS subroot, z.h AS root, sha256(f.way || {' || '.join(over)}) AS proof_sha256, {met} AS folded_root "
        f"FROM f{joins} JOIN b{lang_levels} z ON z.pos = 0)"
    )
    return "WITH " + ",\n".join(parts + folds) + "\nSELECT *, folded_root = root AS verified FROM g"
