"""Readers and writers of books, texts, logs and audio headers. Binary parts are opened from Spark's own reader, so any store works."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

_ITEM = "path string, title string, authors array<string>, language string, dates array<string>, spine_ord int, item_id string, href string, media_type string, properties string, content binary"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def epub_items(raw: bytes) -> Iterator[dict]:
    """Manifest items of an EPUB package with its metadata; spine_ord is null for items outside the spine."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        of = lambda name: [(e.text or "").strip() for e in package.iter() if _local(e.tag) == name and (e.text or "").strip()]
        meta = {"title": (of("title") or [""])[0], "authors": of("creator"), "language": (of("language") or [""])[0], "dates": of("date")}
        order = {e.get("idref"): i for i, e in enumerate(x for x in package.iter() if _local(x.tag) == "itemref")}
        for e in package.iter():
            if _local(e.tag) == "item":
                href = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(e.get("href", ""))))
                yield meta | {"spine_ord": order.get(e.get("id")), "item_id": e.get("id", ""), "href": href, "media_type": e.get("media-type", ""), "properties": e.get("properties", ""), "content": z.read(href) if href in names else None}


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest item of every EPUB under path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in _ITEM.split(", ")]
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame([{"path": r.path} | x for x in epub_items(r.content)], columns=cols).astype({"spine_ord": "Int32"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, _ITEM)


def book_metadata(items: DataFrame) -> DataFrame:
    """One row per book: title, authors, language, dates, and the year found first in any date."""
    year = F.regexp_extract(F.coalesce(F.try_element_at(F.filter("dates", lambda d: d.rlike(r"(19|20)\d{2}")), F.lit(1)), F.lit("")), r"((?:19|20)\d{2})", 1)
    return items.groupBy("path").agg(*(F.first(c).alias(c) for c in ("title", "authors", "language", "dates"))).withColumn("year", year)


def cover_items(items: DataFrame) -> DataFrame:
    """The cover image of each book: by property, then by id or name, then the largest image."""
    from pyspark.sql import Window

    prio = F.when(F.contains("properties", F.lit("cover-image")), 0).when(F.lower("item_id").contains("cover"), 1).when(F.lower("href").contains("cover"), 2).otherwise(3)
    w = Window.partitionBy("path").orderBy(prio, -F.coalesce(F.length("content"), F.lit(0)), "href")
    return items.filter("media_type LIKE 'image/%'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text) of text files; the title is a Markdown heading on the first line, else from the file's name."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    head = T.markdown_title(F.col("text"))
    return d.select("path", F.when(head != "", head).otherwise(T.filename_title(F.col("path"))).alias("title"), T.clean_reader(F.col("text")).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines log; blank and broken lines, and lines that are no objects, are skipped."""
    lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
    return lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).filter("x._bad IS NULL").select("x.*").drop("_bad")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def wav_info(raw: bytes) -> tuple[int, int, int] | None:
    """(channels, sample rate, frames) of a RIFF/WAVE file, or None."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(raw):
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data" and form and form[4]:
            return form[1], form[2], size // form[4]
        at += 8 + size + size % 2
    return None


def read_wav_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, channels, rate, frames, duration_ms, valid) of WAV files; valid ones are mono and not empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *(wav_info(bytes(c)) or (0, 0, 0))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "channels", "rate", "frames"])

    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, channels int, rate int, frames long")
    return d.withColumn("duration_ms", F.when(F.col("rate") > 0, F.round(F.col("frames") * 1000.0 / F.col("rate")).cast("long")).otherwise(0)).withColumn("valid", (F.col("channels") == 1) & (F.col("frames") > 0))


def parse_overrides(lines: DataFrame, line: str = "line") -> DataFrame:
    """Override lines as base, reading, mode: comments go, bullets are stripped, the first wide or plain equals sign or tab parts; one-character bases are isolated."""
    t = F.regexp_replace(F.trim(line), r"^[-*•] ", "")
    sep = F.when(F.contains(t, F.lit("＝")), F.instr(t, "＝")).when(F.contains(t, F.lit("=")), F.instr(t, "=")).otherwise(F.instr(t, "\t"))
    own = lines.withColumn("__t", t).withColumn("__at", sep).filter(~F.col("__t").startswith("#") & (F.col("__at") > 1))
    base = F.trim(F.substring("__t", F.lit(1), F.col("__at") - 1))
    out = own.withColumn("base", base).withColumn("reading", F.trim(F.substring("__t", F.col("__at") + 1, F.length("__t"))))
    return out.withColumn("mode", F.when(F.length("base") == 1, "isolated")).filter("base <> '' AND reading <> ''").drop("__t", "__at")


def concat_list(segments: DataFrame) -> DataFrame:
    """One row per chapter: the lines of a concatenation list, in order."""
    rows = F.array_sort(F.collect_list(F.struct("chunk", "path")))
    return segments.groupBy("book", "chapter").agg(F.array_join(F.transform(rows, lambda x: F.concat(F.lit("file '"), F.replace(x.path, F.lit("'"), F.lit("'\\''")), F.lit("'"))), "\n").alias("lines"))


def chapter_metadata(timed: DataFrame) -> DataFrame:
    """Chapter blocks of a media metadata file from (book, chapter, title, start_ms, end_ms)."""
    return timed.select("book", "chapter", F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), T.metadata_escape(F.col("title"))).alias("block"))
