"""Session set-up and the shared folder that survives the loss of an executor."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", app: str = "aeolis", memory: str = "16g") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Tables staged by this process, for ``drop_staged``.
STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: the cluster names it in ``spark.checkpoint.dir``; it is Spark's checkpoint folder as well.

    Only a master in one process (``local``, ``local[...]``) may go without; it then gets a fresh temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="aeolis-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)  # checkpointInterval of the tree learners needs it
    return named


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, keeps columns prunable."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.partitionBy(*partition_by).parquet(path)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables staged so far; call it when every result that reads them has been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while STAGED:
        path = jvm.org.apache.hadoop.fs.Path(STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
