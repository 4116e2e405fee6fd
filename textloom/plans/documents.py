"""Queries of segmentation, HTML, sources, streaming and incremental planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import html, segment, unicode
from textloom.functions.segment import SECTION
from textloom.operators import analytics
from textloom.plans.common import table
from textloom.shared import shared_dir
from textloom.sources import files
from textloom.streaming import boundary

def q_chunk_fixtures(spark, sf):
    """Turns of conversations without a bound on chunks: the lines stay apart, and nothing but blanks is lost."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.translate("text", ".", "。").alias("t"))
    found = segment.chunks(c, "t", ["conv_id", "turn"], 1_000_000, 0)
    one = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    return found.groupBy("conv_id", "turn").agg(F.md5(F.array_join(F.transform(one, lambda x: x.text), "|")).alias("h"))


def q_chunks(spark, sf):
    return segment.chunks(table(spark, sf, "documents"), "text", ["doc_id"], 200, 40).select("doc_id", "chunk", "start", "end", F.md5("text").alias("h"))


def q_pack(spark, sf):
    o = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).alias("x"))
    g = o.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("l_orderkey", F.array_join(segment.pack_lengths(F.transform("xs", lambda x: x.q), 80).cast("array<string>"), ",").alias("packs"))


def q_pauses(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk"), F.when(F.length("text") % 3 == 0, f"\n\n{SECTION}\n\n").otherwise("\n").alias("gap"), "role", F.length("text").alias("n"))
    heading = F.when((F.col("role") == "system") | (F.col("n") % 11 == 0), 5).when(F.col("n") % 7 == 0, 3).otherwise(0)
    return segment.pause_multipliers(c, ["conv_id"], heading).select("conv_id", "chunk", "pause")


def q_page_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", html.html_text("html").alias("x"))
    return p.select("page_id", F.col("x.headings")[0]["text"].alias("h1"), F.size("x.headings").alias("n_headings"), F.length("x.text").alias("n_chars"), F.md5("x.text").alias("h"))


def q_page_links(spark, sf):
    """Links of pages with their targets and words."""
    p = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1))).alias("href"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.min("href").alias("first_href"))


def q_class_ratio(spark, sf):
    """Classes of elements over all pages, and how often they stand on div elements."""
    p = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'(<[a-z0-9]+ class="[^"]*")'), F.lit(1))).alias("m"))
    c = p.select(F.regexp_extract("m", "^<([a-z0-9]+)", 1).alias("tag"), F.regexp_extract("m", 'class="([^"]*)"', 1).alias("cls"))
    return c.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tag") == "div").alias("hits")).filter("hits >= 4 AND hits >= 0.8 * n")


def q_ruby(spark, sf):
    """Turns of conversations as pages whose first word has a reading."""
    esc = lambda t: F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.regexp_extract("text", r"^(\S*)", 1)
    h = F.concat(F.lit("<p><ruby>"), esc(first), F.lit("<rp>(</rp><rt>よ み</rt><rp>)</rp></ruby>"), esc(F.expr(r"substring(text, length(regexp_extract(text, '^(\\S*)', 1)) + 1)")), F.lit("</p>"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", html.html_text(h).alias("x"))
    return rows.select("conv_id", "turn", F.md5("x.text").alias("h"), F.array_join(F.transform("x.ruby", lambda r: F.concat_ws(":", r.start.cast("string"), r.end.cast("string"), r.base, r.reading)), ",").alias("ruby"))


def q_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", unicode.slug("text").alias("slug"))


def q_overrides(spark, sf):
    p = table(spark, sf, "part")
    line = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("# "), F.col("p_name"))).when(F.col("p_size") % 5 == 1, F.concat(F.lit("- "), F.col("p_name"), F.lit(" = "), F.col("p_brand"))).when(F.col("p_size") % 5 == 2, F.concat(F.lit("• x＝"), F.col("p_type"))).when(F.col("p_size") % 5 == 3, F.concat(F.col("p_name"), F.lit("\t"), F.col("p_type"))).otherwise(F.col("p_name"))
    return files.parse_overrides(p.select("p_partkey", line.alias("line"))).select("p_partkey", "base", "reading", "mode")


def q_chapter_metadata(spark, sf):
    from textloom.plans.analytics import chunks_of

    timed = analytics.cumulative(analytics.chapter_durations(chunks_of(spark, sf)))
    return files.chapter_metadata(timed.withColumn("title", F.concat(F.lit("Chapter #"), F.col("chapter").cast("string"))))


def q_concat(spark, sf):
    from textloom.plans.analytics import chunks_of

    c = chunks_of(spark, sf).filter("duration_ms IS NOT NULL").withColumn("path", F.concat_ws("/", F.lit("it's"), F.col("chapter").cast("string"), F.concat(F.lpad(F.col("chunk").cast("string"), 6, "0"), F.lit(".wav"))))
    return files.concat_list(c)


def q_plan(spark, sf):
    """What a rebuild does with each document, given an older state: texts unchanged by hash are reused."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    old = d.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("sha")).alias("old_sha"))
    action = F.when(F.col("sha") == F.col("old_sha"), "reuse").when(F.trim("text") == "", "empty").when(F.trim("text").rlike("^[.…⋯]+$"), "silence").otherwise("build")
    return d.join(old, "doc_id", "left").select("doc_id", action.alias("action"))


def q_stale(spark, sf):
    """Documents of an older state that the present one no longer has with the same text."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    old = d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha")).alias("sha"))
    return old.join(d, ["doc_id", "sha"], "left_anti")


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def q_stream(spark, sf):
    """Events through the streaming ingest; equal to a batch run over the same rows."""
    at = shared_dir(spark)
    raw = _events(spark, sf).select("event_id", F.col("event_type").alias("trigger"), (F.col("value") * 10).cast("string").alias("delta_ms"), (F.col("value") / 50).alias("playback_rate"), F.get_json_object("props", "$.k").alias("pad_ms"))
    boundary.ingest(raw, f"{at}/table", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/table")


def q_positions(spark, sf):
    at = shared_dir(spark)
    raw = _events(spark, sf).select(F.col("user_id").alias("book"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("position"))
    boundary.upsert_positions(raw, spark, f"{at}/table", f"{at}/checkpoint")
    return boundary.positions(spark, f"{at}/table").select("book", "last", "furthest")


QUERIES = {
    "a13_class_ratio": q_class_ratio, "f6_slug": q_slug, "f12_page_text": q_page_text, "f12_page_links": q_page_links, "f13_ruby": q_ruby, "m2_plan": q_plan, "m3_stale": q_stale, "s18_chapter_metadata": q_chapter_metadata, "s18_concat_list": q_concat, "s20_overrides": q_overrides,
    "t1_stream_ingest": q_stream, "t5_positions": q_positions, "w6_pack": q_pack, "w8_chunks": q_chunks, "w8_chunk_fixtures": q_chunk_fixtures, "w9_pauses": q_pauses,
}

_AN = __import__("textloom.plans.analytics", fromlist=["_CHUNKS"])._CHUNKS
ORACLES = {
    "a13_class_ratio": """WITH m AS (SELECT unnest(regexp_extract_all(html, '<[a-z0-9]+ class="[^"]*"')) AS m FROM pages) SELECT regexp_extract(m, 'class="([^"]*)"', 1) AS cls, count(*) AS n, count(*) FILTER (m LIKE '<div %') AS hits FROM m GROUP BY 1 HAVING hits >= 4 AND hits >= 0.8 * n""",
    "f6_slug": """WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^ -~\\n]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS x FROM documents) SELECT doc_id, CASE WHEN x = '' THEN 'chapter' ELSE substr(x, 1, 60) END AS slug FROM s""",
    "f12_page_links": """SELECT page_id, count(*) AS links, min(h) AS first_href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS h FROM pages) GROUP BY page_id""",
    "f13_ruby": r"""SELECT conv_id, turn, md5(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))) AS h, CASE WHEN w = '' THEN '' ELSE '0:' || length(w) || ':' || w || ':よみ' END AS ruby FROM (SELECT *, regexp_extract(text, '^(\S*)', 1) AS w FROM conversations)""",
    "m2_plan": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'reuse' WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(trim(text), '^[.…⋯]+$') THEN 'silence' ELSE 'build' END AS action FROM documents",
    "m3_stale": "SELECT doc_id, 'x' AS sha FROM documents WHERE doc_id % 7 = 0",
    "s18_chapter_metadata": f"""WITH {_AN}, t AS (SELECT book, chapter, CAST(sum(greatest(duration_ms, 1)) OVER w AS BIGINT) AS e, greatest(duration_ms, 1) AS d FROM chapters WINDOW w AS (PARTITION BY book ORDER BY chapter))
SELECT book, chapter, '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - d) || chr(10) || 'END=' || e || chr(10) || 'title=Chapter ' || chr(92) || '#' || chapter AS block FROM t""",
    "s18_concat_list": f"""WITH {_AN} SELECT book, chapter, string_agg('file ''it''' || chr(92) || '''''s/' || chapter || '/' || lpad(CAST(chunk AS VARCHAR), 6, '0') || '.wav''', chr(10) ORDER BY chunk) AS lines FROM chunks WHERE duration_ms IS NOT NULL GROUP BY book, chapter""",
    "s20_overrides": """SELECT p_partkey, CASE p_size % 5 WHEN 2 THEN 'x' ELSE p_name END AS base, CASE p_size % 5 WHEN 1 THEN p_brand ELSE p_type END AS reading, CASE p_size % 5 WHEN 2 THEN 'isolated' END AS mode FROM part WHERE p_size % 5 IN (1, 2, 3)""",
    "t1_stream_ingest": r"""SELECT event_id, event_type AS trigger, round(value * 10, 3) AS delta_ms, round(greatest(0.25, least(4.0, value / 50)), 3) AS playback_rate, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS pad_ms FROM events""",
    "t5_positions": r"""SELECT user_id AS book, arg_max(k, event_id) AS last, max(k) AS furthest FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events) GROUP BY user_id""",
    "w6_pack": """WITH RECURSIVE o AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS i FROM lineitem),
f AS (SELECT l_orderkey, i, q AS used, 1 AS no FROM o WHERE i = 1 UNION ALL SELECT o.l_orderkey, o.i, CASE WHEN f.used + o.q <= 80 THEN f.used + o.q ELSE o.q END, CASE WHEN f.used + o.q <= 80 THEN f.no ELSE f.no + 1 END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.i = f.i + 1)
SELECT l_orderkey, string_agg(CAST(no AS VARCHAR), ',' ORDER BY i) AS packs FROM f GROUP BY l_orderkey""",
    "w8_chunk_fixtures": """SELECT conv_id, turn, md5(array_to_string(list_filter(list_transform(string_split(replace(text, '.', '。'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|')) AS h FROM conversations WHERE trim(text) <> ''""",
    "w9_pauses": """WITH h AS (SELECT conv_id, turn, CASE WHEN role = 'system' OR length(text) % 11 = 0 THEN 5 WHEN length(text) % 7 = 0 THEN 3 ELSE 0 END AS own, CASE WHEN length(text) % 3 = 0 THEN 3 ELSE 1 END AS sec FROM conversations)
SELECT conv_id, turn AS chunk, CAST(CASE WHEN lead(turn) OVER w IS NULL THEN 1 ELSE greatest(sec, own, lead(own) OVER w) END AS INT) AS pause FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
}
