"""Streaming ingest of player events: validated rows are appended to a table; positions are upserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.shared import path_of, written


def clean_events(raw: DataFrame) -> DataFrame:
    """Boundary events with typed, clamped fields; rows without a trigger or with a delta beyond an hour are dropped."""
    rate = F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.coalesce(F.col("playback_rate").try_cast("double"), F.lit(1.0))))
    delta = F.round(F.col("delta_ms").try_cast("double"), 3)
    return raw.select("event_id", F.substring(F.trim("trigger"), 1, 32).alias("trigger"), delta.alias("delta_ms"), F.round(rate, 3).alias("playback_rate"), F.coalesce(F.col("pad_ms").try_cast("long"), F.lit(0)).alias("pad_ms")).filter((F.col("trigger") != "") & (F.abs("delta_ms") <= 3_600_000))


def ingest(source: DataFrame, path: str, checkpoint: str) -> None:
    """Append the cleaned rows of a stream to a Parquet table, over all that is available; a restart goes on where it stopped."""
    clean_events(source).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


BUCKETS = 64


def _bucket(book) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(BUCKETS)).cast("int")


def positions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """(book, seen, last, furthest) as of the last batch, or as of the one before `before`; None if there is none. A bucket's newest version counts."""
    p, fs = path_of(spark, path)
    if not fs.exists(p):
        return None
    newest: dict[int, int] = {}
    for b in fs.globStatus(path_of(spark, f"{path}/bucket=*/v=*")[0]):
        bucket, v = int(b.getPath().getParent().getName()[7:]), int(b.getPath().getName()[2:])
        if (before is None or v < before) and v >= newest.get(bucket, -1):
            newest[bucket] = v
    if not newest:
        return None
    return spark.read.option("basePath", path).schema("book long, seen long, last long, furthest long, bucket int, v long").parquet(*(f"{path}/bucket={b}/v={v}" for b, v in newest.items()))


def upsert_positions(source: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> None:
    """Last and furthest position per book from a stream (book, event_id, position), in BUCKETS buckets of books.

    A batch is merged with the newest versions of the buckets that its books fall into, and writes new versions of these only; others are neither read nor written.
    A batch that is tried again reads what was there before it and writes the same versions. Of a touched bucket the version before stays, older ones are deleted.
    Events without a book are left out.
    """

    def merge(batch: DataFrame, no: int) -> None:
        new = batch.filter("book IS NOT NULL").groupBy("book").agg(F.max("event_id").alias("seen"), F.max_by("position", "event_id").alias("last"), F.max("position").alias("furthest")).withColumn("bucket", _bucket("book"))
        new = written(new)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            return
        old = positions(spark, path, before=no)
        if old is not None:
            new = new.unionByName(old.filter(F.col("bucket").isin(touched)).drop("v"))
        out = new.groupBy("bucket", "book").agg(F.max("seen").alias("seen"), F.max_by("last", "seen").alias("last"), F.max("furthest").alias("furthest")).withColumn("v", F.lit(no).cast("long"))
        out.repartition("bucket").write.partitionBy("bucket", "v").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for b in touched:
            stale = sorted(int(s.getPath().getName()[2:]) for s in path_of(spark, path)[1].listStatus(path_of(spark, f"{path}/bucket={b}")[0]) if s.getPath().getName().startswith("v="))
            for v in [v for v in stale if v < no][:-1]:
                p, fs = path_of(spark, f"{path}/bucket={b}/v={v}")
                fs.delete(p, True)

    source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
