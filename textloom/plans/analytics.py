"""Queries of the analytics operators over the test tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import analytics as A
from textloom.plans.common import table

# a book is a customer, its chapters are orders, a chapter's chunks are line items; returned items have no duration yet
_CHUNKS = """
chunks AS (
  SELECT o_custkey AS book, o_orderkey AS chapter, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS chunk,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity * 1000 AS BIGINT) END AS duration_ms, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
chapters AS (
  SELECT book, chapter, count(*) AS n_chunks, count(duration_ms) AS n_done, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS duration_ms FROM chunks GROUP BY book, chapter)
"""
_EVENTS = """
boundary AS (
  SELECT event_type AS trigger, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, value AS delta_ms, user_id FROM events),
valid AS (
  SELECT k % 3 AS pad_ms, delta_ms, CASE WHEN k BETWEEN 5 AND 95 THEN CAST(k AS DOUBLE) END AS latency FROM boundary WHERE trigger = 'click' AND k % 10 <> 0)
"""


def chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    w = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("chapter"), F.row_number().over(w).alias("chunk"), F.when(F.col("l_returnflag") != "R", (F.col("l_quantity") * 1000).cast("long")).alias("duration_ms"), "l_linestatus")


def boundaries_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(
        F.when(F.col("event_type") == "click", "gapless").otherwise(F.col("event_type")).alias("trigger"), (F.col("k") % 10 != 0).alias("preloaded"), F.lit(1.0).alias("playback_rate"), F.col("value").alias("delta_ms"),
        F.when(F.col("k").between(5, 95), F.col("k").cast("double")).otherwise(F.lit(-1.0)).alias("output_latency_ms"), (F.col("k") % 3).alias("pad_ms"), "user_id",
    )


def q_boundary_report(spark, sf):
    return A.boundary_report(boundaries_of(spark, sf))


def q_series_stats(spark, sf):
    return A.series_stats(table(spark, sf, "events"), "value", ["event_type"])


def q_chapter_durations(spark, sf):
    return A.chapter_durations(chunks_of(spark, sf))


def q_progress(spark, sf):
    return A.progress(chunks_of(spark, sf))


def q_cumulative(spark, sf):
    return A.cumulative(A.chapter_durations(chunks_of(spark, sf)))


def q_until_missing(spark, sf):
    c = chunks_of(spark, sf).withColumn("present", (F.col("duration_ms").isNotNull()) & (F.col("l_linestatus") == "F") | (F.col("chunk") <= 3))
    return A.until_missing(c).groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("chapter", "chunk")).alias("l")).select("book", "n", F.col("l.chapter").alias("last_chapter"), F.col("l.chunk").cast("long").alias("last_chunk"))


def q_split_parts(spark, sf):
    chapters = A.chapter_durations(chunks_of(spark, sf)).withColumn("parts", F.lit(3))
    return A.split_parts(chapters)


def q_auto_parts(spark, sf):
    d = A.chapter_durations(chunks_of(spark, sf)).groupBy("book").agg(F.sum("duration_ms").alias("total_ms"))
    return d.select("book", "total_ms", A.auto_parts(F.col("total_ms"), 0.25).cast("long").alias("parts"))


def q_library(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("book"), F.concat(F.lit("The "), F.col("c_name")).alias("title"))
    played = table(spark, sf, "events").groupBy(F.col("user_id").alias("book")).agg(F.count(F.lit(1)).alias("furthest"))
    return A.library(chunks_of(spark, sf), names, played)


def q_chapter_end_pause(spark, sf):
    c = chunks_of(spark, sf).withColumn("pause", F.when(F.col("l_linestatus") == "F", 3).otherwise(1))
    return A.pause_at_chapter_end(c).select("book", "chapter", F.col("chunk").cast("long").alias("chunk"), "pause")


def q_coverage(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("n_chars").alias("chars"), "lang")
    return A.coverage_choice(d.filter("lang <> 'fr'"), d)


def q_otsu(spark, sf):
    return A.otsu(table(spark, sf, "events"), "value")


def q_distinct_pads(spark, sf):
    return A.valid_boundaries(boundaries_of(spark, sf)).select("pad_ms").distinct().orderBy("pad_ms")


def q_book_details(spark, sf):
    c = chunks_of(spark, sf)
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "duration_ms"))), lambda x: F.coalesce(x.duration_ms.cast("string"), F.lit("-"))), ",")
    return c.groupBy("book", "chapter").agg(one.alias("durations"), F.count(F.lit(1)).alias("n"))


_STATS = "round({0}, 3)"


def _pick(q: float) -> str:
    return f"round(list_extract(vs, CAST(floor((len(vs) - 1) * {q}) AS BIGINT) + 1), 3)"


QUERIES = {
    "a16_series_stats": q_series_stats, "a17_boundary_report": q_boundary_report, "a18_progress": q_progress, "a20_library": q_library, "a21_book_details": q_book_details, "a22_chapter_durations": q_chapter_durations,
    "a23_coverage": q_coverage, "a27_otsu": q_otsu, "u7_distinct_pads": q_distinct_pads, "w9b_chapter_end_pause": q_chapter_end_pause, "w13_cumulative": q_cumulative, "w14_split_parts": q_split_parts, "w14b_auto_parts": q_auto_parts,
    "w17_until_missing": q_until_missing,
}

ORACLES = {
    "a16_series_stats": f"""
SELECT event_type, n, round(vs[1], 3) AS "min", {_pick(.10)} AS p10, {_pick(.25)} AS p25, {_pick(.50)} AS p50, {_pick(.75)} AS p75, {_pick(.90)} AS p90, round(vs[-1], 3) AS "max", round(m, 3) AS mean
FROM (SELECT event_type, count(*) AS n, list_sort(list(value)) AS vs, avg(value) AS m FROM events GROUP BY event_type)""",
    "a17_boundary_report": f"""
WITH {_EVENTS}, s AS (
  SELECT (SELECT count(*) FROM events) AS samples_total, count(*) AS samples_filtered, count(latency) AS samples_with_latency, list_sort(list(delta_ms)) AS ds, avg(delta_ms) AS dm,
         list_sort(list(delta_ms + latency) FILTER (latency IS NOT NULL)) AS cs, avg(delta_ms + latency) AS cm, array_to_string(list_sort(list(DISTINCT pad_ms)), ',') AS pad_values FROM valid)
SELECT samples_total, samples_filtered, samples_with_latency, round(samples_with_latency / samples_filtered, 4) AS coverage, pad_values,
       round(ds[CAST(floor((len(ds) - 1) * .5) AS BIGINT) + 1], 3) AS delta_p50, round(dm, 3) AS delta_mean, round(cs[CAST(floor((len(cs) - 1) * .5) AS BIGINT) + 1], 3) AS corrected_p50, round(cm, 3) AS corrected_mean,
       CASE WHEN samples_filtered >= 200 AND samples_with_latency >= .8 * samples_filtered THEN CAST(round_even(cs[CAST(floor((len(cs) - 1) * .5) AS BIGINT) + 1], 0) AS BIGINT) END AS recommended,
       CASE WHEN samples_filtered >= 200 AND samples_with_latency >= .8 * samples_filtered THEN 'p50(delta_ms + output_latency_ms)' ELSE 'insufficient_data' END AS basis FROM s""",
    "a18_progress": f"""
WITH {_CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chapter, chunk) AS no FROM chunks)
SELECT book, count(*) AS total, count(duration_ms) AS done, round(100.0 * count(duration_ms) / count(*), 2) AS percent, min(no) FILTER (duration_ms IS NULL) AS missing_no,
       arg_min(chapter, no) FILTER (duration_ms IS NULL) AS missing_chapter, arg_min(chunk, no) FILTER (duration_ms IS NULL) AS missing_chunk FROM n GROUP BY book""",
    "a20_library": f"""
WITH {_CHUNKS}, t AS (SELECT book, count(*) AS total, count(duration_ms) AS done, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS d FROM chunks GROUP BY book), p AS (SELECT user_id AS book, count(*) AS furthest FROM events GROUP BY 1)
SELECT c_custkey AS book, 'The ' || c_name AS title, lower(c_name) AS sort_key, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(d, 0) AS duration_ms,
       coalesce(total > 0 AND furthest >= total - 1, false) AS complete FROM customer LEFT JOIN t ON t.book = c_custkey LEFT JOIN p ON p.book = c_custkey""",
    "a21_book_details": f"WITH {_CHUNKS} SELECT book, chapter, string_agg(coalesce(CAST(duration_ms AS VARCHAR), '-'), ',' ORDER BY chunk) AS durations, count(*) AS n FROM chunks GROUP BY book, chapter",
    "a22_chapter_durations": f"WITH {_CHUNKS} SELECT * FROM chapters",
    "a23_coverage": """
SELECT source AS book, CAST(coalesce(sum(n_chars) FILTER (lang <> 'fr'), 0) AS BIGINT) AS toc_chars, CAST(sum(n_chars) AS BIGINT) AS spine_chars,
       CASE WHEN coalesce(sum(n_chars) FILTER (lang <> 'fr'), 0) < 0.9 * sum(n_chars) THEN 'spine' ELSE 'toc' END AS source FROM documents GROUP BY source""",
    "a27_otsu": """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), p AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 256)) AS INT), 255) AS bin FROM events, b),
h AS (SELECT bin, count(*) AS n FROM p GROUP BY bin),
s AS (SELECT bin, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER () AS nt, sum(n * bin) OVER () AS st FROM h WINDOW w AS (ORDER BY bin)),
v AS (SELECT bin, CASE WHEN nt > n0 THEN round(CAST(n0 AS DOUBLE) / nt * ((nt - n0) / CAST(nt AS DOUBLE)) * pow(s0 / CAST(n0 AS DOUBLE) - (st - s0) / CAST(nt - n0 AS DOUBLE), 2), 6) ELSE 0 END AS score FROM s)
SELECT bin, round(lo + (bin + 1) * (hi - lo) / 256, 6) AS threshold FROM (SELECT bin FROM v ORDER BY score DESC, bin LIMIT 1), b""",
    "u7_distinct_pads": f"WITH {_EVENTS} SELECT DISTINCT pad_ms FROM valid",
    "w9b_chapter_end_pause": f"""
WITH {_CHUNKS} SELECT book, chapter, chunk, CASE WHEN chunk = max(chunk) OVER (PARTITION BY chapter) AND chapter < max(chapter) OVER (PARTITION BY book) THEN 5 WHEN l_linestatus = 'F' THEN 3 ELSE 1 END AS pause FROM chunks""",
    "w13_cumulative": f"""
WITH {_CHUNKS} SELECT book, chapter, CAST(sum(greatest(duration_ms, 1)) OVER w - greatest(duration_ms, 1) AS BIGINT) AS start_ms, CAST(sum(greatest(duration_ms, 1)) OVER w AS BIGINT) AS end_ms FROM chapters WINDOW w AS (PARTITION BY book ORDER BY chapter)""",
    "w14_split_parts": f"""
WITH RECURSIVE {_CHUNKS}, c AS (SELECT book, chapter, duration_ms AS d, row_number() OVER (PARTITION BY book ORDER BY chapter) AS i, count(*) OVER (PARTITION BY book) AS n, sum(duration_ms) OVER (PARTITION BY book) AS total FROM chapters),
f AS (
  SELECT book, i, CAST(total AS BIGINT) AS rest, 3 AS parts, CAST(d AS BIGINT) AS cur, 1 AS part FROM c WHERE i = 1
  UNION ALL
  SELECT book, i, CASE WHEN full_ THEN rest1 - cur1 ELSE rest1 END, CASE WHEN full_ THEN parts1 - 1 ELSE parts1 END, CASE WHEN full_ THEN d ELSE cur1 + d END, part + CASE WHEN forced OR full_ THEN 1 ELSE 0 END
  FROM (SELECT *, parts > 1 AND NOT forced AND cur1 + d > rest1 / CAST(parts1 AS DOUBLE) AND n - i + 1 >= parts1 AS full_
    FROM (SELECT *, CASE WHEN forced THEN rest - cur ELSE rest END AS rest1, CASE WHEN forced THEN parts - 1 ELSE parts END AS parts1, CASE WHEN forced THEN 0 ELSE cur END AS cur1
      FROM (SELECT c.book, c.i, c.d, c.n, f.rest, f.parts, f.cur, f.part, f.parts > 1 AND c.n - c.i + 1 = f.parts AS forced FROM f JOIN c ON c.book = f.book AND c.i = f.i + 1))))
SELECT c.book, c.chapter, c.d AS duration_ms, f.part FROM f JOIN c USING (book, i)""",
    "w14b_auto_parts": f"WITH {_CHUNKS} SELECT book, CAST(sum(duration_ms) AS BIGINT) AS total_ms, CASE WHEN sum(duration_ms) <= 900000 THEN 1 ELSE CAST(ceil(sum(duration_ms) / 900000) AS BIGINT) END AS parts FROM chapters GROUP BY book",
    "w17_until_missing": f"""
WITH {_CHUNKS}, p AS (SELECT *, duration_ms IS NOT NULL AND l_linestatus = 'F' OR chunk <= 3 AS present FROM chunks),
s AS (SELECT *, sum(CASE WHEN NOT present AND coalesce(duration_ms > 0, true) THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY chapter, chunk) AS holes FROM p)
SELECT book, count(*) AS n, max(chapter) AS last_chapter, arg_max(chunk, chapter * 1000 + chunk) AS last_chunk FROM s WHERE holes = 0 AND present GROUP BY book""",
}
