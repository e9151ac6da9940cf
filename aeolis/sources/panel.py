"""Readers and writers: fact table, dimension tables, features, scaler, model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeolis.functions.scalar import nan_to_null
from aeolis.operators.blocks import from_end
from aeolis.operators.boosting import HISTORY_SCHEMA, NODE_SCHEMA, Booster
from aeolis.session import stage

MEASURES = ("wspd", "wdir", "etmp", "itmp", "ndir", "pab1", "pab2", "pab3", "prtv", "patv")

# Column order of the sensor file (fixed format).
PANEL_SCHEMA = T.StructType(
    [
        T.StructField("TurbID", T.LongType()),
        T.StructField("Day", T.LongType()),
        T.StructField("Tmstamp", T.StringType()),
        *[T.StructField(m.capitalize(), T.DoubleType()) for m in MEASURES],
    ]
)
CURVE_SCHEMA = "TurbID BIGINT, a DOUBLE, beta DOUBLE, b DOUBLE, mx DOUBLE, cp DOUBLE"
ANGLE_SCHEMA = "diff_angle DOUBLE, TurbID BIGINT"


def _snake(df: DataFrame) -> DataFrame:
    return df.toDF(*["turb_id" if c.lower() == "turbid" else c.lower() for c in df.columns])


def read_panel(spark: SparkSession, path: str, fmt: str = "csv", partial_days: int | None = None) -> DataFrame:
    """Sensor history or request file with an explicit schema; ``date`` orders rows in time.

    ``partial_days`` keeps the first days only; on Parquet the filter reaches the scan.
    """
    reader = spark.read.schema(PANEL_SCHEMA)
    raw = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    out = nan_to_null(_snake(raw))
    return with_date(first_days(out, partial_days))


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.struct("day", "tmstamp"))


def first_days(df: DataFrame, days: int | None) -> DataFrame:
    return df if days is None else df.filter(F.col("day") <= days)


def recent_tail(df: DataFrame, steps: int, pos: str = "slot", entity: Sequence[str] = ("turb_id",)) -> DataFrame:
    """The newest ``steps`` grid steps of every entity, for online use."""
    return from_end(df, entity, pos).filter(F.col("_from_end") < steps).drop("_from_end")


def read_curve(spark: SparkSession, path: str, turbines: DataFrame | None = None) -> DataFrame:
    """Power curve of each turbine; ``cp`` may be missing."""
    return checked(_dimension(spark, path, CURVE_SCHEMA), ("a", "beta", "b", "mx"), turbines)


def read_angle(spark: SparkSession, path: str, turbines: DataFrame | None = None) -> DataFrame:
    """Direction offset of each turbine."""
    return checked(_dimension(spark, path, ANGLE_SCHEMA), ("diff_angle",), turbines)


def _dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, whose columns may stand in any order; values that don't fit their type end the read."""
    kinds = dict(part.split() for part in schema.split(", "))
    raw = spark.read.csv(path, header=True)
    here = {c.lower(): c for c in raw.columns}
    return _snake(raw.select(*[(F.col(f"`{here[c.lower()]}`") if c.lower() in here else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]))


def checked(rows: DataFrame, needed: Sequence[str], turbines: DataFrame | None = None, key: str = "turb_id") -> DataFrame:
    """``rows``, if each has a key of its own and all of ``needed``, and every one of ``turbines`` has a row; else a ValueError.

    A dimension with a double key would multiply the rows it joins, one with gaps would lose or blank some. One aggregate
    and one anti-join tell; only counts reach the driver.
    """
    gaps = F.count_if(F.col(key).isNull() | F.greatest(*[F.col(c).isNull() for c in needed], F.lit(False)))
    n, keys, holes = rows.agg(F.count(F.lit(1)), F.count_distinct(key), gaps).first()
    if holes:
        raise ValueError(f"{holes} rows lack {key} or one of {', '.join(needed)}")
    if keys < n:
        raise ValueError(f"{n - keys} rows repeat a {key}")
    if turbines is not None:
        absent = turbines.select(key).distinct().join(rows.select(key), key, "left_anti").count()
        if absent:
            raise ValueError(f"{absent} turbines have no row")
    return rows


def write_features(df: DataFrame, path: str) -> None:
    """Partitioned by split, so that reading one split prunes the others."""
    df.write.mode("overwrite").partitionBy("data_type").parquet(path)


def read_split(spark: SparkSession, path: str, data_type: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).filter(F.col("data_type") == data_type)


def stage_features(df: DataFrame) -> DataFrame:
    return stage(df, "features", ("data_type",))


def stage_scaler(scaler: DataFrame) -> DataFrame:
    """Save and re-read the (entity, feature, mean, std) table."""
    return stage(scaler, "scaler")


def save_model(model: Booster, spark: SparkSession, path: str) -> None:
    """The model as its node table and its errors by round, both Parquet."""
    model.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
    model.errors(spark).write.mode("overwrite").parquet(f"{path}/errors")


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")


def load_model(spark: SparkSession, path: str) -> Booster:
    nodes = load_nodes(spark, path).orderBy("model_id", "tree_id", "node_id").collect()
    errors = spark.read.schema(HISTORY_SCHEMA).parquet(f"{path}/errors").orderBy("round").collect()
    return Booster([tuple(r) for r in nodes], [tuple(r) for r in errors], sorted({r["feature"] for r in nodes if r["feature"]}))
