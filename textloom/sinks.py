"""Sinks that may be run again: partitions are overwritten as a whole, stale ones pruned, and a manifest is written last."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.shared import path_of, written


def finished_versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a manifest, in order. A version without Spark's mark of success was broken off."""
    p, fs = path_of(spark, path)
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    numbers = sorted(int(n[2:]) for n in names if n.startswith("v="))
    return [n for n in numbers if fs.exists(path_of(spark, f"{path}/v={n}/_SUCCESS")[0])]


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(keys..., n, digest) of what a sink has published last; None if it has finished nothing yet."""
    done = finished_versions(spark, f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest/v={done[-1]}") if done else None


def publish(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Write rows as Parquet, a folder for each scope, the first key: what the rows hold of a scope replaces all of it.

    1. The folders of scopes that have rows are overwritten dynamically; Spark's commit moves them only when all tasks are done, so a lost or repeated
       task leaves nothing behind. Rows with the same keys are in one file, in order; the files are as many as the tasks that have rows of a scope, however many keys
       it has. 2. The manifest, with the number of rows and a digest for all values of the keys, is written as a new version. A run that breaks off at any point leaves the last manifest as it was, and running it again ends in the
       same tables. Other scopes are not touched or read. Rows with null keys are refused. Null columns are kept; digests read them as a sign of their own.
    """
    spark = rows.sparkSession
    if rows.filter(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))).head(1):
        raise ValueError("rows without a key have no partition")
    data = f"{path}/data"
    rows.repartition(*keys).sortWithinPartitions(*keys, *order).write.partitionBy(keys[0]).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(data)
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns if c not in keys]
    one = F.sha2(F.concat_ws("\x1f", *rest), 256)
    digest = F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.struct(*order, one.alias("h")))).h), 256)
    new = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), digest.alias("digest")))
    scopes = new.select(keys[0]).distinct()
    done = finished_versions(spark, f"{path}/manifest")
    old = [spark.read.parquet(f"{path}/manifest/v={done[-1]}").join(scopes, keys[0], "left_anti")] if done else []
    number = done[-1] + 1 if done else 0
    reduce(DataFrame.unionByName, [new, *old]).write.mode("overwrite").parquet(f"{path}/manifest/v={number}")
    for n in done[:-1]:
        p, fs = path_of(spark, f"{path}/manifest/v={n}")
        fs.delete(p, True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk texts (book, chapter, chunk, text), a folder for each book and an entry of the manifest for each chapter."""
    publish(chunks.select("book", "chapter", "chunk", "text"), path, ["book", "chapter"], ["chunk"])


def write_books(chapters: DataFrame, path: str) -> None:
    """Chapters of books (book, ord, title, source, text, headings ...) and their contents: numbered anew from 1, one partition a book."""
    from textloom.operators.spans import renumber

    rows = renumber(chapters, ["book"], ["ord"]).select("book", "index", "title", "source", "text", F.to_json("headings").alias("headings"))
    publish(rows, f"{path}/chapters", ["book"], ["index"])
    publish(rows.select("book", "index", "title", "source", F.concat(F.lpad(F.col("index").cast("string"), 4, "0"), F.lit("-"), F.substring(F.md5("title"), 1, 8), F.lit(".txt")).alias("path")), f"{path}/toc", ["book"], ["index"])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and then renamed."""
    aside, fs = path_of(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    there, _ = path_of(spark, path)
    if fs.exists(there):
        fs.delete(there, False)
    if not fs.rename(aside, there):
        raise OSError(f"{path} can't be replaced")


def read_json(spark: SparkSession, paths: str, schema: str) -> DataFrame:
    """(path, value) of JSON files, a row each; an invalid file has a null value, and a folder without files gives no rows."""
    try:
        raw = spark.read.option("wholetext", True).text(paths)
    except AnalysisException:  # nothing there
        raw = spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    return raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("value"))
