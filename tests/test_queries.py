"""Every query with a checking statement, side by side with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from aeolis.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLE) & set(registry.ENTRIES)))
def test_query_matches(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, df.collect()) == canonical(names, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["mae", "rmse", "score"]


def test_only_fitted_or_random_queries_lack_a_statement():
    assert set(registry.ENTRIES) - set(ORACLE) == {
        "repair_patv_model", "repair_patv_farm_model", "ts_ar_coefficient", "train_boosted_trees",
        "top_feature_importance", "train_grid_models", "reconcile_overlapping",
        "long_leg_features", "long_leg_score", "long_leg_forecast", "short_leg_values", "short_leg_forecast",
        "combined_forecast",
    }
