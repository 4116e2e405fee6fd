"""Progress, duration and latency analytics over chapters, chunks and player events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranks import values_at

QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def low_percentile(sorted_values: Column, q: float) -> Column:
    """The value at index floor((n - 1) q) of a sorted array; null for an empty one."""
    return F.try_element_at(sorted_values, (F.floor((F.size(sorted_values) - 1) * F.lit(q)) + 1).cast("int"))


def series_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, min, p10 .. p90, max and mean (3 decimals) of the non-null values per group.

    The quantiles come from counted values in buckets (see ranks), so no group, and no table without groups, is ordered in one task.
    """
    own = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    plain = own.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    picked = values_at(own, "v", by, QUANTILES)
    x, y = plain.alias("x"), picked.alias("y")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = x.join(y, same, "left").select(*[F.col(f"x.{c}") for c in by], F.coalesce("n", F.lit(0)).alias("n"), "min", *QUANTILES, "max", "mean")
    return both.select(*by, "n", *(F.round(c, 3).alias(c) for c in ("min", *QUANTILES, "max", "mean")))


def valid_boundaries(events: DataFrame) -> DataFrame:
    """Gapless, preloaded boundaries at normal speed with a plausible delta; latency out of 0..5000 ms is dropped to null."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rate, delta, latency = (F.col(c).cast("double") for c in ("playback_rate", "delta_ms", "output_latency_ms"))
    keep = (F.col("trigger") == "gapless") & F.col("preloaded") & finite(rate) & rate.between(0.95, 1.05) & finite(delta) & delta.between(-5000, 5000)
    return events.filter(F.coalesce(keep, F.lit(False))).withColumn("output_latency_ms", F.when(finite(latency) & latency.between(0, 5000), latency)).withColumn("delta_ms", delta)


def boundary_report(events: DataFrame, min_samples: int = 200, least_coverage: float = 0.8) -> DataFrame:
    """One row: sample counts, latency coverage, distinct pads, percentiles of delta and corrected delta, recommended pad change.

    Percentiles are exact, from counted values (see series_stats).
    """
    own = valid_boundaries(events).select("pad_ms", "delta_ms", "output_latency_ms", (F.col("delta_ms") + F.col("output_latency_ms")).alias("corrected"))
    total = events.agg(F.count(F.lit(1)).alias("samples_total"))
    counts = own.agg(F.count(F.lit(1)).alias("samples_filtered"), F.count("output_latency_ms").alias("samples_with_latency"), F.array_sort(F.collect_set("pad_ms")).alias("pads"))
    stats = [series_stats(own, c, []).select(F.col("p50").alias(f"{name}_p50"), F.col("mean").alias(f"{name}_mean")) for c, name in (("delta_ms", "delta"), ("corrected", "corrected"))]
    row = total.join(counts)
    for s in stats:
        row = row.join(s, how="left")
    coverage = F.when(F.col("samples_filtered") > 0, F.col("samples_with_latency") / F.col("samples_filtered")).otherwise(F.lit(0.0))
    enough = (F.col("samples_filtered") >= min_samples) & (coverage >= least_coverage)
    return row.select(
        "samples_total", "samples_filtered", "samples_with_latency", F.round(coverage, 4).alias("coverage"), F.array_join(F.col("pads").cast("array<string>"), ",").alias("pad_values"),
        "delta_p50", "delta_mean", "corrected_p50", "corrected_mean", F.when(enough, F.bround("corrected_p50", 0).cast("long")).alias("recommended"),
        F.when(enough, F.lit("p50(delta_ms + output_latency_ms)")).otherwise(F.lit("insufficient_data")).alias("basis"),
    )


def chapter_durations(chunks: DataFrame) -> DataFrame:
    """Per book and chapter: chunks, finished chunks, milliseconds (a missing duration counts 0)."""
    return chunks.groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("duration_ms").alias("n_done"), F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("duration_ms"))


def progress(chunks: DataFrame) -> DataFrame:
    """Per book: total, done, percent (2 decimals), and the first chunk without a duration with its number in the book."""
    w = Window.partitionBy("book").orderBy("chapter", "chunk")
    ranked = chunks.withColumn("no", F.row_number().over(w))
    first = F.min(F.when(F.col("duration_ms").isNull(), F.struct("no", "chapter", "chunk")))
    out = ranked.groupBy("book").agg(F.count(F.lit(1)).alias("total"), F.count("duration_ms").alias("done"), first.alias("f"))
    return out.select("book", "total", "done", F.round(100.0 * F.col("done") / F.col("total"), 2).alias("percent"), F.col("f.no").cast("long").alias("missing_no"), F.col("f.chapter").alias("missing_chapter"), F.col("f.chunk").cast("long").alias("missing_chunk"))


def cumulative(chapters: DataFrame) -> DataFrame:
    """Start and end of each chapter on the book's time line; a chapter lasts 1 ms at least."""
    w = Window.partitionBy("book").orderBy("chapter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.greatest("duration_ms", F.lit(1))
    end = F.sum(length).over(w)
    return chapters.select("book", "chapter", (end - length).alias("start_ms"), end.alias("end_ms"))


def until_missing(chunks: DataFrame) -> DataFrame:
    """The chunks of a book before its first missing one; holes with a duration of 0 or less are skipped.

    A chunk is missing if it is not present and its duration is not known to be 0 or less.
    """
    w = Window.partitionBy("book").orderBy("chapter", "chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = ~F.col("present") & F.coalesce(F.col("duration_ms") > 0, F.lit(True))
    return chunks.withColumn("stop", F.max(missing.cast("int")).over(w)).filter("stop = 0 AND present").drop("stop")


def auto_parts(total_ms: Column, hours: float = 10.0) -> Column:
    return F.when(F.lit(hours) <= 0, 1).when(total_ms <= hours * 3_600_000, 1).otherwise(F.ceil(total_ms / F.lit(hours * 3_600_000)))


def split_parts(chapters: DataFrame, parts: str = "parts") -> DataFrame:
    """Part number (from 1) of each chapter (book, chapter, duration_ms, parts): parts end at chapter ends, near the average of what remains.

    A part ends before a chapter that would take it over the average of what remains, and where as many chapters as parts
    are left. The fold runs over one book's chapters.
    """
    rows = chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", "duration_ms"))).alias("cs"), F.max(parts).alias("p"))

    def step(a: Column, x: Column) -> Column:
        c, left = F.col("cs")[x], F.size("cs") - x
        many = a.parts > 1
        forced = many & (a.n > 0) & (left == a.parts)
        rest1, parts1, cur1, n1 = F.when(forced, a.rest - a.cur).otherwise(a.rest), F.when(forced, a.parts - 1).otherwise(a.parts), F.when(forced, F.lit(0).cast("long")).otherwise(a.cur), F.when(forced, 0).otherwise(a.n)
        full = many & (n1 > 0) & ((cur1 + c.duration_ms).cast("double") > rest1 / parts1) & (left >= parts1)
        cut = forced | full
        return F.struct(
            F.when(full, rest1 - cur1).otherwise(rest1).alias("rest"), F.when(full, parts1 - 1).otherwise(parts1).alias("parts"),
            (F.when(full, F.lit(0).cast("long")).otherwise(cur1) + c.duration_ms).alias("cur"), (F.when(full, 0).otherwise(n1) + 1).alias("n"),
            F.concat(a.at, F.array(F.when(F.size(a.at) == 0, F.lit(1)).otherwise(F.element_at(a.at, -1) + F.when(cut, 1).otherwise(0)))).alias("at"),
        )

    start = F.struct(F.aggregate("cs", F.lit(0).cast("long"), lambda s, c: s + c.duration_ms).alias("rest"), F.col("p").cast("int").alias("parts"), F.lit(0).cast("long").alias("cur"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    done = rows.withColumn("at", F.aggregate(F.sequence(F.lit(0), F.size("cs") - 1), start, step, lambda a: a.at))
    return done.select("book", F.posexplode("cs").alias("i", "c"), "at").select("book", F.col("c.chapter").alias("chapter"), F.col("c.duration_ms").alias("duration_ms"), F.col("at")[F.col("i")].alias("part"))


def library(chunks: DataFrame, names: DataFrame, playback: DataFrame) -> DataFrame:
    """Per book (book, title) its totals and whether playback has reached the end; sorted keys drop a leading the, a, an."""
    totals = chunks.groupBy("book").agg(F.count(F.lit(1)).alias("total"), F.count("duration_ms").alias("done"), F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("duration_ms"))
    out = names.join(totals, "book", "left").join(playback, "book", "left")
    key = F.regexp_replace(F.lower("title"), "^(the|a|an) ", "")
    total = F.coalesce("total", F.lit(0))
    return out.select("book", "title", key.alias("sort_key"), total.cast("long").alias("total"), F.coalesce("done", F.lit(0)).cast("long").alias("done"), F.coalesce("duration_ms", F.lit(0)).cast("long").alias("duration_ms"), F.coalesce((total > 0) & (F.col("furthest") >= total - 1), F.lit(False)).alias("complete"))


def pause_at_chapter_end(chunks: DataFrame, least: int = 5) -> DataFrame:
    """The last chunk of every chapter but a book's last gets a pause of at least `least`."""
    own = Window.partitionBy("book", "chapter").orderBy("chunk")
    book = Window.partitionBy("book")
    last = F.lead("chunk").over(own).isNull() & (F.col("chapter") < F.max("chapter").over(book))
    return chunks.withColumn("pause", F.when(last, F.greatest("pause", F.lit(least))).otherwise(F.col("pause")))


def coverage_choice(toc: DataFrame, spine: DataFrame, least: float = 0.9) -> DataFrame:
    """Per book whether to read by table of contents or by spine: by spine if the contents cover under `least` of its characters."""
    both = spine.groupBy("book").agg(F.sum("chars").alias("spine_chars")).join(toc.groupBy("book").agg(F.sum("chars").alias("toc_chars")), "book", "left")
    got = F.coalesce("toc_chars", F.lit(0))
    return both.select("book", got.cast("long").alias("toc_chars"), F.col("spine_chars").cast("long").alias("spine_chars"), F.when((F.col("spine_chars") > 0) & (got < least * F.col("spine_chars")), "spine").otherwise("toc").alias("source"))


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """Otsu's threshold of a column: the bin edge of the largest between-class variance, the first of equals.

    One pass for the range, one for the histogram; cumulative sums run over the bins, not over the rows.
    """
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.select(value).crossJoin(F.broadcast(bounds)).select(F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int").alias("bin"), "lo", "hi")
    hist = placed.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("lo", "hi")
    sums = hist.select("bin", "lo", "hi", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(every).alias("n1"), F.sum(F.col("n") * F.col("bin")).over(every).alias("s1"))
    n0, n1 = F.col("n0").cast("double"), (F.col("n1") - F.col("n0")).cast("double")
    gap = F.col("s0") / n0 - (F.col("s1") - F.col("s0")) / F.nullif(n1, F.lit(0.0))
    scored = sums.withColumn("score", F.coalesce(F.round(n0 / F.col("n1") * (n1 / F.col("n1")) * gap * gap, 6), F.lit(0.0)))
    best = scored.groupBy("lo", "hi").agg(F.max_by("bin", F.struct("score", -F.col("bin"))).alias("bin"))
    return best.select("bin", F.round(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins, 6).alias("threshold"))
