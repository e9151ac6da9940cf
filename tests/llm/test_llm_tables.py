"""Mixing, Jaccard join, licences and the pipeline; statements side by side with DuckDB."""

import glob
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from aeolis.llm import jaccard, licenses, mixing, queries
from aeolis.llm.common import table

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, rel = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())


def on_edge(sql, edge_rows):
    con = duckdb.connect()
    pdf = pd.DataFrame([r[:5] for r in edge_rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con.register("raw", pdf)
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM raw")
    rel = con.execute(sql)
    return [c[0] for c in rel.description], rel.fetchall()


def test_mixing_of_odd_rows(spark, edge, empty, edge_rows):
    out = mixing.poisson_mix(edge)
    assert "Copy" not in out.columns and {"copy", "rank", "own_id"} <= set(out.columns)
    names, want = on_edge(mixing.oracle(), edge_rows)
    assert rows_of(names, out.select(*names).collect()) == rows_of(names, want)
    assert mixing.poisson_mix(empty).count() == 0


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "'abcdefghij' as text", "if(id % 10 = 0, 'small', 'large') as source")
    weights = spark.createDataFrame([("small", 1.0), ("large", 1.0), ("absent", 5.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.poisson_mix(docs, weights).groupBy("source").count().collect()}
    total = 20_000  # the absent source takes no share
    assert n["small"] == pytest.approx(total, rel=0.05) and n["large"] == pytest.approx(total, rel=0.05)
    first = mixing.poisson_mix(docs, weights).select("doc_id").limit(1000).toPandas()["doc_id"]
    assert not first.is_monotonic_increasing


def test_mixing_of_a_rare_source(spark):
    """Rates far beyond 8: a source of a thousandth of the characters takes half of the result, one of a hundred-thousandth a fifth."""
    docs = spark.range(100_000).selectExpr("id as doc_id", "'abcdefghij' as text", "case when id = 7 then 'least' when id % 1000 = 0 then 'small' else 'large' end as source")
    weights = spark.createDataFrame([("small", 5.0), ("large", 3.0), ("least", 2.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.poisson_mix(docs, weights, max_rate=None).groupBy("source").count().collect()}
    assert n["small"] == pytest.approx(50_000, rel=0.05) and n["large"] == pytest.approx(30_000, rel=0.05) and n["least"] == pytest.approx(20_000, rel=0.05)
    for rate in (0.0, 0.3, 8.0, 150.0, 400.0, 20_000.0):
        low, cdf = mixing.distribution(rate)
        p = np.diff(cdf, prepend=0.0)
        k = low + np.arange(len(p))
        assert abs(cdf[-1] - 1) < 1e-9 and abs((p * k).sum() - rate) < 1e-6 * max(1.0, rate) and abs((p * (k - rate) ** 2).sum() - rate) < 1e-4 * max(1.0, rate)


def shingle_set(text, k):
    words = jaccard.WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_groups(rows, k, percent):
    """(n, component) of (id, text) rows: all pairs compared."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(up[i], []).append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, len(s), least[u]) for (d, _), s, u in zip(rows, sets, up, strict=True)]


def copies(seed, n):
    """Texts of all lengths, with chains of ever more changed copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        text = rng.choices(words, k=rng.choice([1, 2, 4, 9, 20, 60, 200]))
        for _ in range(rng.choice([1, 1, 2, 12])):
            rows.append((len(rows), " ".join(text)))
            for _ in range(max(0, len(text) // rng.choice([40, 60, 150]))):
                text[rng.randrange(len(text))] = rng.choice(words)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("tile, block, unit", [(8192, 1 << 18, 1 << 21), (20, 300, 500)])
def test_join_is_complete(spark, monkeypatch, k, percent, tile, block, unit):
    for name, value in (("TILE", tile), ("BLOCK_TOKENS", block), ("UNIT_TOKENS", unit)):
        monkeypatch.setattr(jaccard, name, value)
    rows = copies(k, 90)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(rows, k, percent))


def test_join_of_odd_rows(spark, edge, empty, edge_rows):
    got = sorted((tuple(r) for r in jaccard.near_duplicates(edge).collect()), key=repr)
    # A group whose only rows lack an id has no component id; a row without words is its own.
    want = sorted(brute_groups([r[:2] for r in edge_rows], 3, 90), key=repr)
    assert got == want
    assert jaccard.near_duplicates(empty).count() == 0


def test_keep_one(spark, edge, empty, edge_rows):
    out = jaccard.keep_one(edge, 3, 90)
    assert out.columns == edge.columns
    groups = brute_groups([r[:2] for r in edge_rows], 3, 90)
    wordless = {(r[0], r[1] or "") for r, g in zip(edge_rows, groups, strict=True) if g[1] == 0}
    n = len({g[2] for g in groups if g[1]}) + 1 + len(wordless)  # 1: the other text with id 0 is a group of its own
    assert out.count() == n
    assert jaccard.keep_one(empty).count() == 0


def test_licences(spark):
    files = [
        ("LICENSE", "Released under the MIT License."), ("src/main.c", "int main"), ("src/lib/COPYING", "intro\nLicensed under the Apache License, Version 2.0."),
        ("src/lib/a/b.c", "void f"), ("src/x.c", "code\nThis work is licensed under the GNU General Public License, version 3.\nmore"), ("src/lib/c.c", "All our licensed plumbers"),
    ]
    rows = {r["path"]: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: (r["license"], r["origin"], r["inherited_from"]) for p, r in rows.items()} == {
        "LICENSE": ("MIT", "own", None), "src/main.c": ("MIT", "inherited", ""), "src/lib/COPYING": ("Apache-2.0", "own", None),
        "src/lib/a/b.c": ("Apache-2.0", "inherited", "src/lib"), "src/x.c": ("GPL-3.0", "own", None), "src/lib/c.c": ("Apache-2.0", "inherited", "src/lib"),
    }


def test_licences_of_odd_rows(spark, edge, empty, edge_rows):
    out = licenses.scan(edge)
    assert out.count() == len(edge_rows) and [c.lower() for c in out.columns].count("license") == 1
    names, want = on_edge(licenses.oracle(), edge_rows)
    assert rows_of(names, licenses.scanned_documents(edge).select(*names).collect()) == rows_of(names, want)
    assert licenses.scanned_documents(empty).count() == 0


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_stages_on_odd_rows(spark, request, edge_labels, which, tmp_path):
    edge_labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = request.getfixturevalue(which)
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    assert (docs.count() > 0) == (which == "edge")


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    groups = brute_groups(list(known.items()), 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g[2] for g in groups})
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} <= {g[2] for g in groups} | set(known)
