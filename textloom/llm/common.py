"""What the training-data operators share: scratch tables, table loading, small numeric helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.shipping import ship

#: The white space of every word rule here: space and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"


#: An Arrow batch ends at so many rows or bytes: texts vary from nothing to many MB, and a Python worker holds a batch or two.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Sets the session's bounds of Arrow batches, which Spark knows per session only."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir. Where that is unset, a local master has one of its own; a cluster gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts the lineage, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise has written, once no result that is still to be computed reads them, and let Spark delete the shuffle files that nothing refers to."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call when no result that reads them is needed any more."""
    _delete(spark, scratch_dir(spark))


def hot_keys(weight: DataFrame, on: str, share: int = 1024) -> DataFrame | None:
    """(on, __parts) of the keys that over 1 / share of all rows hold, at most `share` of them; None without any. weight: (on, n), about how many rows hold a key."""
    total, most = weight.agg(F.sum("n"), F.max("n")).first()
    if not total or most * share <= total:
        return None
    return weight.filter(F.col("n") * share > total).select(on, F.ceil(F.col("n") * share / F.lit(total)).cast("int").alias("__parts"))


def sorted_join(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting: a table that grows with the input never passes through the driver, however small its files look."""
    return df.hint("merge")


def spread_join(left: DataFrame, right: DataFrame, on: str, hot: DataFrame | None, by: str, how: str = "inner", where=None) -> DataFrame:
    """left.join(right, on, how) with the hot keys (hot_keys of left) dealt over many tasks; where: a further condition.

    A hot key is cut into parts of about 1 / share of all rows by the hash of left's column `by`, the same in every attempt of
    a task; right's rows of that key are repeated for each part. The hot keys are few, so they can be sent to all tasks. Neither side
    is: both grow with the input, and a file's size says little about the memory that its rows take on the driver.
    """
    if hot is None:
        right = sorted_join(right)
        return left.join(right, on, how) if where is None else left.join(right, (left[on] == right[on]) & where, how).drop(right[on])
    parts = F.coalesce("__parts", F.lit(1))
    x = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    y = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    y = sorted_join(y)
    if where is None:
        return x.join(y, [on, "__salt"], how).drop("__salt")
    return x.join(y, (x[on] == y[on]) & (x["__salt"] == y["__salt"]) & where, how).drop(y[on], x["__salt"], y["__salt"])


def release() -> None:
    """Give what a Python task has freed back to the system: workers are used again, by other operators too."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc_mod(doc_id, n: int):
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def free_name(taken, stem: str) -> str:
    """A column name that is not among those taken (case-insensitive)."""
    low, name = {c.lower() for c in taken}, stem
    while name.lower() in low:
        name += "_"
    return name
