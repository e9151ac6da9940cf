import random

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `Copy` string, rank int, spans string, n long, side int, digest string, license string, own_id int, path string"


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs in every column, empty and blank texts, very long ones, ties, repeated rows and ids, columns of clashing names."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Zeta", "mail a.b@c.de", "10.0.0.1", "+1 (415) 555-2671", "été", "4111 1111 1111 1111"]
    text = " ".join(rng.choice(words) for _ in range(60))
    long_ = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [text, text, text + " more", None, "", " ", "\n", "x", "one two", "x" * 100_000, long_, "a  b\tc \n d", "1 2 3", "Ünï cödé 你好 世界", long_ + " tail", "All rights reserved."]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[8], (0, "another text with the id of the first", None, None, None), (None, text, None, None, None), (None, None, None, None, None), (99, None, "en", "s1", 0)]
    return [(*r, 0.5, "c", 7, "x", 1, 2, "d", "l", 3, f"a/b/{r[0]}" if r[0] else None) for r in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(15)] + [(3, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def edge_vectors(spark):
    rng = random.Random(5)
    vectors = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(120)]
    rows = [(i, v, 1.0, 2) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[40], 1.0, 2) for i in range(30)]  # ties
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 8, [None] + [1.0] * 7, [nan] + [1.0] * 7, [inf] + [1.0] * 7, [], [0.5, 0.25], [0.25, 0.5]]
    rows += [(300 + 20 * i, v, 1.0, 2) for i, v in enumerate(odd)] + [rows[0], rows[40], (None, vectors[1], 0.0, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int").persist()


@pytest.fixture(scope="session")
def frame():
    def of(df):
        pdf = df.toPandas()
        return pdf.astype(object).where(pd.notna(pdf), None)

    return of
