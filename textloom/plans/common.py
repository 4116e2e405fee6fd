"""Access to the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.shipping import ship


#: An Arrow batch ends at so many bytes, and at Spark's number of rows: texts vary from nothing to many MB, and a Python worker holds a batch or two.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Sets the session's bound of Arrow batches, which Spark knows per session only."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A small fixture as a table; columns map names to types."""
    ship(spark)
    return spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in columns.items()))
