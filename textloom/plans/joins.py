"""Queries of look-ups, fallbacks and range joins: parts are chapters, conversations and events are sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import joins as J
from textloom.plans.analytics import _CHUNKS, chunks_of
from textloom.plans.common import table



def q_headings(spark, sf):
    p = table(spark, sf, "part")
    none = F.array().cast("array<string>")
    chapters = p.select(F.col("p_partkey").alias("chapter"), (F.col("p_partkey") % 40).alias("source_index"), F.col("p_name").alias("file"), F.when(F.col("p_size") % 3 == 0, F.array("p_brand")).otherwise(none).alias("headings"))
    by_index = p.filter("p_size % 4 = 0").select((F.col("p_partkey") % 50).alias("source_index"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 8 == 0, F.array("p_type")).otherwise(none).alias("headings"))
    by_file = p.filter("p_size > 40").select(F.col("p_name").alias("file"), F.col("p_partkey").alias("ord"), F.array("p_brand", "p_type").alias("headings"))
    return J.headings_with_fallback(chapters, by_index, by_file).select("chapter", F.array_join("headings", "|").alias("headings"))


def q_voices(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("chapter"))
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("chapter"), F.when(F.col("s_suppkey") % 3 == 0, " ").when(F.col("s_suppkey") % 3 == 1, "default").otherwise(F.col("s_name")).alias("voice"))
    return J.voices(c, m, "narrator")


def q_raw_of(spark, sf):
    """The raw chapter behind each clean one, by its source index."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.select("o_orderkey", F.col("o_custkey").alias("source_index")).join(c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("source_index"), F.col("c_name").alias("raw")), "source_index", "left").select("o_orderkey", "raw")


def q_followers(spark, sf):
    c = table(spark, sf, "events").select((F.col("user_id") % 50).alias("book"), F.col("event_id").alias("pos"), "event_type")
    return J.followers(c.filter("event_type = 'signup'").select("book", "pos"), c.filter("event_type <> 'signup'").select("book", "pos", (F.col("event_type") != "error").alias("continues")))


def _report(p, chapters):
    chapters = chapters.select(F.col("p_partkey").alias("chapter"), F.concat(F.lit("clean/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.col("p_partkey").cast("string"), F.lit(".txt")).alias("name"), F.col("p_name").alias("title"))
    report = p.filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("/x/clean/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("p_size") > 30, F.col("p_name")).alias("title"))
    return J.report_rows(chapters, report)


def q_report(spark, sf):
    p = table(spark, sf, "part")
    return _report(p, p)


def q_title_pages(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("ord"), F.col("text").alias("text"))
    return J.absorb_title_pages(c).select("book", "ord", F.md5("text").alias("h"))


def q_passed_titles(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 60).alias("book"), F.col("event_id").alias("ord"), F.when(F.col("event_type").isin("view", "click"), F.lit(" ")).otherwise(F.concat_ws("-", "event_type", F.col("event_id").cast("string"))).alias("title"), F.col("event_type").isin("view", "signup").alias("empty"))
    return J.titles_passed_on(e)


def q_totals(spark, sf):
    return J.totals(chunks_of(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("book")))


def q_frames(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x.value).alias("v"))
    return g.select("user_id", F.posexplode(J.frames(F.col("v"), 8, 4)).alias("i", "rms")).select("user_id", "i", F.round("rms", 4).alias("rms"))


def q_hrefs(spark, sf):
    """Links of pages, written in four ways, from pages in folders."""
    base = F.format_string("b%d/t/p%d.html", F.col("page_id") % 7, F.col("page_id"))
    links = F.regexp_extract_all("html", F.lit(r'<a href="/([^"]*)">'), F.lit(1))
    p = table(spark, sf, "pages").select("page_id", base.alias("base"), F.posexplode(links).alias("i", "x")).withColumn("x", F.replace("x", F.lit("%"), F.lit("p")))
    href = F.when(F.col("i") % 4 == 0, F.concat(F.lit("/"), "x")).when(F.col("i") % 4 == 1, F.concat(F.lit("../"), F.replace("x", F.lit("p"), F.lit("%70")))).when(F.col("i") % 4 == 2, F.concat(F.lit("./"), "x", F.lit("#top"))).otherwise(F.concat(F.lit("#"), "x"))
    return p.select("page_id", "i", J.resolve_href(F.col("base"), href).alias("target"))


def q_contents(spark, sf):
    """Contents entries met with the items they point to; of several entries for an item the first counts."""
    p = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1))).alias("ord", "href"))
    return J.first_of(p, ["page_id", "href"], ["ord"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("s"))


def q_selection(spark, sf):
    """The first chapter of every book, and those chosen by key."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("chapter"))
    return J.first_of(o, ["book"], ["chapter"]).unionByName(o.filter(F.col("chapter").isin(5, 50, 500))).distinct()


QUERIES = {
    "a19_totals": q_totals, "j3_headings": q_headings, "j6_raw_chapter": q_raw_of, "j7_voices": q_voices, "j9_hrefs": q_hrefs, "j10_contents": q_contents, "j11_followers": q_followers, "j12_passed_titles": q_passed_titles, "j18_report_rows": q_report, "p24_selection": q_selection,
    "w15_title_pages": q_title_pages, "w22_frames": q_frames,
}

ORACLES = {
    "a19_totals": f"WITH {_CHUNKS} SELECT book, count(*) AS total, CASE WHEN book IN (SELECT s_suppkey FROM supplier) THEN count(*) ELSE count(duration_ms) END AS done, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS duration_ms FROM chunks GROUP BY book",
    "j3_headings": """WITH i AS (SELECT p_partkey % 50 AS k, arg_min(CASE WHEN p_size % 8 = 0 THEN p_type END, p_partkey) FILTER (true) AS x, min(p_partkey) AS f FROM part WHERE p_size % 4 = 0 GROUP BY 1),
i2 AS (SELECT i.k, CASE WHEN p.p_size % 8 = 0 THEN p.p_type END AS h FROM i JOIN part p ON p.p_partkey = i.f), f AS (SELECT p_name, arg_min(p_brand || '|' || p_type, p_partkey) AS h FROM part WHERE p_size > 40 GROUP BY p_name)
SELECT p_partkey AS chapter, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, i2.h, f.h, '') AS headings FROM part LEFT JOIN i2 ON i2.k = p_partkey % 40 LEFT JOIN f USING (p_name)""",
    "j6_raw_chapter": "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN c_name END AS raw FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "j7_voices": "SELECT c_custkey AS chapter, CASE WHEN s_suppkey IS NULL OR s_suppkey % 3 < 2 THEN 'narrator' ELSE s_name END AS voice FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "j9_hrefs": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS l FROM pages), x AS (SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS i, replace(unnest(l), '%', 'p') AS x0 FROM l), c AS (SELECT *, regexp_replace(x0, '#.*$', '') AS x FROM x)
SELECT page_id, i, CASE i % 4 WHEN 0 THEN x WHEN 1 THEN regexp_replace('b' || page_id % 7 || '/' || x, '/$', '') WHEN 2 THEN regexp_replace('b' || page_id % 7 || '/t/' || x, '/$', '') ELSE 'b' || page_id % 7 || '/t/p' || page_id || '.html' END AS target FROM c""",
    "j10_contents": """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hs FROM pages), p AS (SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS ord FROM l), m AS (SELECT page_id, href, min(ord) AS ord FROM p GROUP BY ALL)
SELECT page_id, count(*) AS n, CAST(sum(ord) AS BIGINT) AS s FROM m GROUP BY page_id""",
    "j11_followers": """WITH e AS (SELECT user_id % 50 AS book, event_id AS pos, event_type AS t, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS start FROM events),
s AS (SELECT *, sum(CASE WHEN t = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY book, start ORDER BY pos) AS bad FROM e WHERE start IS NOT NULL) SELECT book, start, pos FROM s WHERE t <> 'signup' AND bad = 0""",
    "j12_passed_titles": """WITH e AS (SELECT user_id % 60 AS book, event_id AS ord, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type || '-' || event_id END AS title, event_type IN ('view', 'signup') AS empty FROM events),
g AS (SELECT *, sum(CASE WHEN prev THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY ord) AS grp FROM (SELECT *, coalesce(lag(empty) OVER (PARTITION BY book ORDER BY ord), false) AS prev FROM e)),
n AS (SELECT *, arg_min(title, ord) FILTER (title IS NOT NULL) OVER (PARTITION BY book, grp ORDER BY ord ROWS UNBOUNDED PRECEDING) AS named FROM g) SELECT book, ord, coalesce(title, named, '') AS title FROM n WHERE NOT empty""",
    "j18_report_rows": """WITH r AS (SELECT p_partkey AS ord, CASE WHEN p_size > 30 THEN p_name END AS title FROM part WHERE p_partkey % 7 = 0) SELECT p_partkey AS chapter, (SELECT min(ord) FROM r WHERE r.ord = part.p_partkey OR r.title = part.p_name) AS "row" FROM part""",
    "p24_selection": "SELECT o_custkey AS book, min(o_orderkey) AS chapter FROM orders GROUP BY 1 UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey IN (5, 50, 500)",
    "w15_title_pages": """WITH c AS (SELECT conv_id AS book, turn AS ord, text FROM conversations),
j AS (SELECT *, coalesce(length(trim(text)) <= 80 AND NOT contains(trim(text), chr(10)) AND length(lead(text) OVER w) >= 400, false) AS joins FROM c WINDOW w AS (PARTITION BY book ORDER BY ord)),
t AS (SELECT *, coalesce(lag(joins) OVER w, false) AS taken, lag(text) OVER w AS before FROM j WINDOW w AS (PARTITION BY book ORDER BY ord)) SELECT book, ord, md5(CASE WHEN taken THEN before || chr(10) || chr(10) || text ELSE text END) AS h FROM t WHERE NOT joins""",
    "w22_frames": """WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), f AS (SELECT user_id, k // 4 - d AS i, value, n FROM v, range(0, 2) AS r(d) WHERE k // 4 - d >= 0)
SELECT user_id, CAST(i AS INT) AS i, round(sqrt(sum(value * value) / 8), 4) AS rms FROM f WHERE i * 4 + 8 <= n GROUP BY user_id, i""",
}
