"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

HOURLY_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("consumption", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("cloud_cover", T.DoubleType()),
    T.StructField("ev_load_norm", T.DoubleType()),
    T.StructField("solar_gen_norm", T.DoubleType()),
    T.StructField("dsr_active", T.DoubleType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_hourly_csv(spark: SparkSession, path: str,
                    schema: T.StructType = HOURLY_SCHEMA) -> DataFrame:
    """Hourly observations from CSV; columns are found by the header's names.

    The files must share one header. Columns beyond the schema are not returned; a
    missing column is a ValueError, and a cell that does not parse fails the read.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    kinds = {f.name: f.dataType for f in schema}
    stored = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    rows = spark.read.schema(stored).option("header", True).option("enforceSchema", False).option(
        "mode", "FAILFAST").csv(path)
    return rows.select(*[f.name for f in schema])


def write_hourly_csv(df: DataFrame, path: str) -> None:
    """Hourly observations as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_hourly(df: DataFrame, path: str, partition: str | None = "series_id",
                 ts: str = "timestamp") -> None:
    """Hourly observations as Parquet, by default one folder per series.

    Rows are range-partitioned by (partition, time) first: a series lies in few files
    instead of one per task, and a long one still spreads over several tasks. With very
    many series pass a coarser column, such as a month, as ``partition``.
    """
    if partition:
        df.repartitionByRange(partition, ts).write.mode("overwrite").partitionBy(
            partition).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_results_csv(df: DataFrame, path: str) -> None:
    """A small result table (a sweep, a leaderboard) as one CSV file; only its last step runs in one task."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
