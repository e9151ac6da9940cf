"""Tasks of the operators run on workers that haven't got the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver's path only
from pyspark.sql import functions as F
from aeolis.operators import hierarchy, models, segments
from aeolis.operators.feature_blocks import long_leg_blocks
from aeolis.operators.rolling import roll_bundle
from aeolis.session import build_session

spark = build_session(2, "tasks", memory="2g")
rows = spark.range(300).select(
    (F.col("id") % 2).alias("turb_id"), F.floor(F.col("id") / 2).alias("time"), F.floor(F.col("id") / 2).alias("slot"),
    (F.hash("id") % 100).cast("double").alias("patv"), (F.hash("id") % 7).cast("double").alias("wspd"))
model = models.train_boosted_trees(rows, ["wspd"], label="patv", rounds=18, rate=0.3, leaves=4)
assert models.predict(model, rows, "p").filter("p IS NOT NULL").count() == 300
stored = models.predict_stored(rows, model.nodes(spark), "p")
assert stored.filter("p IS NOT NULL").count() == 300
assert models.score_tree_table(rows, model.nodes(spark), ["turb_id", "time"]).count() == 300
assert roll_bundle(rows, ["patv"], [9]).count() == 300
assert long_leg_blocks(rows, ["patv"], 9, 30, 5, size=64).count() == 2 * 121
samples = segments.segment_samples(rows, (12,), ((0, 6),), 24)
fitted = segments.train_segment_models(samples, ((0, 6),), 12)
assert segments.score_segment_models(samples, fitted, ("turb_id", "anchor")).count() > 0
edges = spark.createDataFrame([("all", 0), ("all", 1)], "group_id string, turb_id bigint")
nodes = spark.createDataFrame([("all", 0, 5.0), ("t0", 0, 1.0), ("t1", 0, 1.0)], "node string, step bigint, yhat double")
assert sorted(r["yhat"] for r in hierarchy.reconcile(nodes, edges).collect()) == [2.0, 2.0, 4.0]
spark.stop()
"""


def test_workers_need_no_package(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
