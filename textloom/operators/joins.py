"""Look-ups, fallbacks and range joins between chapters, parts and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key in an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def headings_with_fallback(chapters: DataFrame, by_index: DataFrame, by_file: DataFrame) -> DataFrame:
    """Headings of a chapter (chapter, source_index, file, headings): its own, else those of its source index, else of its file name; the first of duplicates counts."""
    i = first_of(by_index, ["source_index"], ["ord"]).select("source_index", F.col("headings").alias("hi"))
    f = first_of(by_file, ["file"], ["ord"]).select("file", F.col("headings").alias("hf"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    both = chapters.join(i, "source_index", "left").join(f, "file", "left")
    return both.select("chapter", F.coalesce(some("headings"), some("hi"), some("hf"), F.array().cast("array<string>")).alias("headings"))


def voices(chapters: DataFrame, mapping: DataFrame, default: str) -> DataFrame:
    """The voice of each chapter; a missing or blank entry and the word default mean the default one."""
    v = F.trim("voice")
    return chapters.join(mapping, "chapter", "left").select("chapter", F.when(v.isNull() | v.isin("", "default"), F.lit(default)).otherwise(v).alias("voice"))


def followers(starts: DataFrame, items: DataFrame) -> DataFrame:
    """Items (book, pos, continues) that follow a start (book, pos) before the next start, up to the first that doesn't continue.

    One pass over both in order: an item meets the last start before it. No pairs are formed.
    """
    s = starts.filter("pos IS NOT NULL").select("book", "pos", F.lit(None).cast("boolean").alias("continues"), F.lit(0).alias("__kind"), F.col("pos").alias("start"))
    all_ = items.select("book", "pos", F.col("continues").cast("boolean").alias("continues"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("start")).unionByName(s)
    sweep = Window.partitionBy("book").orderBy("pos", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # an item where a start is follows none
    both = all_.filter("book IS NOT NULL").withColumn("start", F.last("start", ignorenulls=True).over(sweep)).filter("__kind = 1 AND start < pos")
    w = Window.partitionBy("book", "start").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("ok", F.min(F.col("continues").cast("int")).over(w)).filter("ok = 1").select("book", "start", "pos")


def report_rows(chapters: DataFrame, report: DataFrame) -> DataFrame:
    """For each chapter (chapter, path, name, title) the first report row (ord, path, title) that matches by the end of its path, by name, or by title.

    Each way is an equi-join of its own with the first row of a name or title, so no row pairs are tried that can't match, and
    repeated titles make no groups of pairs.
    """
    r = report.select(F.col("ord").alias("r_ord"), F.element_at(F.split("path", "/"), -1).alias("r_name"), F.col("title").alias("r_title"))
    first = lambda c: r.groupBy(c).agg(F.min("r_ord").alias("r_ord"))
    by_name = chapters.join(first("r_name"), F.col("name") == F.col("r_name")).select("chapter", "r_ord")
    by_title = chapters.join(first("r_title"), F.col("title") == F.col("r_title")).select("chapter", "r_ord")
    best = by_name.unionByName(by_title).groupBy("chapter").agg(F.min("r_ord").alias("row"))
    return chapters.select("chapter").join(best, "chapter", "left")


def absorb_title_pages(chapters: DataFrame, most: int = 80, least_next: int = 400) -> DataFrame:
    """Chapters (book, ord, text): one of nothing but a title is put before the next one if that is long; alternate ones of a run are consumed."""
    w = Window.partitionBy("book").orderBy("ord")
    lone = (F.length(F.trim("text")) <= most) & ~F.contains(F.trim("text"), F.lit("\n"))
    own = chapters.withColumn("joins", F.coalesce(lone & (F.length(F.lead("text").over(w)) >= least_next), F.lit(False)))
    return own.withColumn("taken", F.coalesce(F.lag("joins").over(w), F.lit(False))).withColumn("text", F.when(F.col("taken"), F.concat(F.lag("text").over(w), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))).filter("NOT joins").select("book", "ord", "text")


def titles_passed_on(chapters: DataFrame) -> DataFrame:
    """A chapter (book, ord, title, empty) without a title of its own takes that of the empty title pages right before it."""
    w = Window.partitionBy("book").orderBy("ord")
    own = chapters.withColumn("grp", F.sum((~F.coalesce(F.lag("empty").over(w), F.lit(False))).cast("int")).over(w))
    first = Window.partitionBy("book", "grp").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.first(F.nullif(F.trim("title"), F.lit("")), ignorenulls=True).over(first)
    return own.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), named, F.lit(""))).filter("NOT empty").select("book", "ord", "title")


def totals(chunks: DataFrame, finished: DataFrame) -> DataFrame:
    """Per book: chunks, done chunks (all, once the book is finished), milliseconds."""
    t = chunks.groupBy("book").agg(F.count(F.lit(1)).alias("total"), F.count("duration_ms").alias("n"), F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("duration_ms"))
    out = t.join(finished.select("book").distinct().withColumn("all", F.lit(True)), "book", "left")
    return out.select("book", "total", F.when(F.col("all"), F.col("total")).otherwise(F.least("n", "total")).alias("done"), "duration_ms")


def frames(samples: Column, size: int, hop: int) -> Column:
    """Root mean squares of an array's frames of `size` samples, `hop` apart."""
    n = F.size(samples)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.sqrt(F.aggregate(F.slice(samples, i + 1, size), F.lit(0.0), lambda a, x: a + x * x) / size))


def resolve_href(base: Column, href: Column) -> Column:
    """A link without its fragment, decoded, relative to the folder of the file it stands in."""
    bare = F.regexp_replace(href, "#.*$", "")
    clean = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)  # a stray % stays as it is
    folder = F.regexp_replace(base, "[^/]*$", "")
    path = F.when(clean.startswith("/"), F.substring(clean, F.lit(2), F.length(clean))).otherwise(F.concat(folder, clean))
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).when(x == "..", a).otherwise(F.concat(a, F.array(x)))
    return F.when(clean == "", base).otherwise(F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))
