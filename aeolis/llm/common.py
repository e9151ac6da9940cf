"""Helpers shared by the operators: tables, folds, column names, bounded text batches, vectorised hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolis.session import stage  # noqa: F401  re-exported: written tables in the shared folder cut lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Batches handed to Python hold so many bytes at most, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns an operator is about to add; names are compared as Spark does, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL ids fall in no fold."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def ranked(df: DataFrame, order: list[str], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with rank, its place (from 0) in the order of ``order``, which starts with ``within``: a place of its own in each of these.

    Rows are dealt by ranges, sorted and written; a row's rank is its place in its partition and what earlier ones hold.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stage(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    parts = held.groupBy(*within, "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = F.sum("size").over(Window.partitionBy(*within).orderBy("part")) - F.col("size")
    parts = stage(parts.select(*within, "part", (before - F.col("first")).alias("shift")), f"{name}-parts")
    return held.join(parts, [*within, "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``most`` bytes of text, one row at least: bounds what a task expands."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
