"""Headline timings on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

The panel has the size of the contest farm in turbines (eleven users make one turbine: 137 at sf0.1) and the
window lengths of a 10-minute grid (288 rolling, 432 series). Every query is run once to warm up and then timed; results
go to Spark's ``noop`` sink, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aeolis.operators import gaps, hierarchy, metrics, rolling, series  # noqa: E402
from aeolis.operators.blocks import step_index  # noqa: E402
from aeolis.plans import forecast as fc  # noqa: E402
from aeolis.plans.fixture import Fixture  # noqa: E402
from aeolis.session import build_session, drop_staged, stage  # noqa: E402
from aeolis.settings import ROLL_FEATURES, PanelSettings  # noqa: E402

ROLL, SERIES, HORIZON = 288, 432, 24


def build(spark, sf_dir):
    d = Fixture(spark, sf_dir, users_per_turbine=11)
    panel = stage(d.panel, "bench-panel")
    d.__dict__["panel"] = panel
    grid = stage(d.full_panel, "bench-grid").withColumn("time", F.col("slot"))
    basis = stage(d.basis, "bench-basis")
    evaluated = stage(d.evaluated, "bench-evaluated")
    settings = PanelSettings(steps_per_day=24, horizon=HORIZON, roll=ROLL, series=SERIES, valid_days=5, test_days=5)
    boosting = fc.Boosting(rounds=5, rate=0.3, leaves=8)
    power = grid.select("turb_id", "time", "patv")
    return {
        "panel_from_events": lambda: Fixture(spark, sf_dir, users_per_turbine=11).panel,
        "step_index": lambda: step_index(panel),
        "fill_missing_slots": lambda: gaps.fill_missing_slots(panel, 24),
        "interp_edges": lambda: gaps.interpolate(grid.select("turb_id", "time", "ndir"), "ndir"),
        "roll_mean": lambda: rolling.trailing(power, {"m": ("mean", "patv")}, ROLL),
        "roll_bundle": lambda: rolling.roll_bundle(basis.select("turb_id", "time", *ROLL_FEATURES), ROLL_FEATURES, [ROLL]),
        "ts_autocorrelation": lambda: series.window_features(power, SERIES, [series.autocorrelation]),
        "series_features": lambda: series.series_features(power, SERIES),
        "hierarchy_rollup": lambda: hierarchy.rollup(panel, d.hier),
        "score_sliding": lambda: metrics.score_sliding(evaluated, HORIZON),
        "long_leg_features": lambda: fc.long_leg_features(panel, d.curve, d.angle, settings, boosting),
    }, panel.count(), grid.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, panel_rows, grid_rows = build(spark, sf_dir)
    times, rows = {}, {}
    for name, q in queries.items():
        for _ in range(1 if name == "long_leg_features" else 2):
            start = time.perf_counter()
            q().write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        rows[name] = q().count() if name in ("series_features", "roll_bundle", "ts_autocorrelation") else None
    print(
        json.dumps(
            {
                "metric": "panel_engine_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "panel_rows": panel_rows,
                "grid_rows": grid_rows,
                "rows_out": {n: k for n, k in rows.items() if k is not None},
                "series_windows_per_sec": round(rows["series_features"] / times["series_features"], 1),
            }
        )
    )
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
