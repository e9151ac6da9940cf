"""Merkle manifest against a plain loop over all rows."""

import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from aeolis.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(nodes, found):
    """The root over nodes of (digest, members); adds each member's siblings to ``found`` and the way up as functions."""
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for run in runs:
            for at, (_, members) in enumerate(run):
                for m in members:
                    found[m].append(([d for d, _ in run[:at]], [d for d, _ in run[at + 1 :]]))
        nodes = [(h("".join(d for d, _ in run)), [m for _, ms in run for m in ms]) for run in runs]
    return nodes[0][0]


def brute(rows):
    langs, found = defaultdict(list), defaultdict(list)
    for i, r in enumerate(rows):
        langs[r["lang"]].append((leaf(r, r["text"]), [i]))
    order = lambda n: (rows[n[1][0]]["doc_id"] is not None, rows[n[1][0]]["doc_id"] or 0, n[0])
    subroots = {lang: climb(sorted(nodes, key=order), found) for lang, nodes in langs.items()}
    tops = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    root = climb([(subroots[x], [m for _, ms in langs[x] for m in ms]) for x in tops], found)
    out = []
    for i, r in enumerate(rows):
        text = r["text"]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        node = leaf(r, text)
        for left, right in found[i]:
            node = h("".join([*left, node, *right]))
        proof = h("".join("".join(a + b) for a, b in found[i]))
        out.append((r["doc_id"], leaf(r, r["text"]), subroots[r["lang"]], root, proof, node, node == root))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def held(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert df.columns == cols
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_addresses_are_a_layout():
    for levels in range(1, 6):
        seen = [int(merkle.address(levels, d, np.arange(8**d))[i]) for d in range(levels) for i in range(8**d)]
        assert sorted(seen) == list(range(merkle.cells(levels)))
        assert merkle.address(levels, 0, 0) == 0
    # The lower parts lie behind the upper one, each in one piece.
    assert merkle.address(4, 2, np.array([0, 1])).tolist() == [9, 18] and merkle.address(4, 3, np.arange(8)).tolist() == list(range(10, 18))


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_equals_a_plain_loop(spark, edge, edge_rows, height):
    """Trees of one block and of several layers of blocks; NULLs, ties, repeated rows, clashing names."""
    names = ("doc_id", "text", "lang", "source", "n_chars")
    many = [(i, f"Text {i}", ("en", "de", None, f"lang{i % 11}")[i % 4], f"s{i % 3}", i) for i in range(100, 420)]
    rows = [dict(zip(names, r[:5], strict=True)) for r in edge_rows] + [dict(zip(names, r, strict=True)) for r in many]
    more = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long")
    got = held(merkle.manifest(edge.unionByName(more, allowMissingColumns=True), height))
    assert got == sorted(brute(rows), key=key)
    assert {r[6] for r in got} == {True, False}


def test_one_document_and_none(spark, edge, empty):
    one = edge.where("doc_id = 8").limit(1)
    [row] = held(merkle.manifest(one))
    assert row[1] == row[2] == row[3] and row[4] == h("") and merkle.manifest(empty).count() == 0


def test_statement_on_odd_rows(spark, edge):
    """The statement itself, on rows that the tables don't hold."""
    con = duckdb.connect()
    con.register("documents", edge.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    rows = con.sql(merkle.oracle(3, 2) + " ORDER BY ALL").fetchall()
    assert sorted(map(tuple, rows), key=key) == held(merkle.manifest(edge))
