"""Queries of the span algebra: line items are intervals in their order; conversations are texts of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import spans as S
from textloom.plans.common import table

_SPANS = """
spans AS (
  SELECT l_orderkey AS chapter, l_partkey % 60 AS start, l_partkey % 60 + CAST(l_quantity AS BIGINT) % 12 + 1 AS "end", l_suppkey AS tag, l_linenumber AS ln, l_returnflag AS flag,
         l_orderkey * 1048576 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem)
"""


def spans_of(spark, sf):
    from pyspark.sql import Window

    i = table(spark, sf, "lineitem")
    start = F.col("l_partkey") % 60
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return i.select(F.col("l_orderkey").alias("chapter"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 12 + 1).alias("end"), F.col("l_suppkey").alias("tag"), F.col("l_linenumber").alias("ln"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * (1 << 20) + F.row_number().over(w)).cast("long").alias("id"))


def q_version(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chapter"), (F.col("o_custkey") % 3).alias("text_hash"), F.lit(0).cast("long").alias("clean_hash"), F.lit(1).cast("long").alias("raw_hash"))
    s = spans_of(spark, sf).select("chapter", F.when(F.col("flag") == "R", "raw").otherwise("clean").alias("version"), "start", "end", "id")
    return S.select_version(o, s).groupBy("chapter", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("s"))


def q_contained(spark, sf):
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chapter"), F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(20))).alias("start")).select("chapter", (F.col("start") / 20).cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), (F.col("start") + 20).cast("long").alias("end"))
    return S.contained(spans_of(spark, sf), chunks).select("chapter", "chunk", "id", "start", "end")


def q_without_overlaps(spark, sf):
    s = spans_of(spark, sf)
    return S.without_overlaps(s.filter("flag <> 'R'"), s.filter("flag = 'R'")).select("chapter", "id")


def q_coalesce(spark, sf):
    c = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).alias("chapter"), (F.col("l_partkey") % 60).alias("start")).distinct()
    s = c.select("chapter", "start", (F.col("start") + 1).alias("end"), F.chr(F.col("start") % 26 + 97).alias("base"), (F.col("start") % 10).cast("string").alias("reading")).filter("(start * 7 + chapter) % 3 > 0")
    return S.coalesce_adjacent(s)


def q_merge(spark, sf):
    return S.merge_ranges(spans_of(spark, sf))


def q_greedy(spark, sf):
    return S.greedy(spans_of(spark, sf), ["id"])


def q_claims(spark, sf):
    s = spans_of(spark, sf).withColumn("kind", (F.col("flag") == "R").cast("int")).withColumn("longest", F.col("start") - F.col("end"))
    return S.first_claims(s, ["kind", "longest", "id"], ["id"])


def q_shift(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("ord"), "text")
    return S.shift_concat(c).select("grp", "ord", F.col("offset").cast("long").alias("offset"))


def q_replace(spark, sf):
    """Every text whole, with spans at fixed places and just before its end."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    n = F.length("t")
    span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.substring("t", s.cast("int") + 1, (e - s).cast("int")).alias("base"), F.concat(F.lit("<"), F.substring("t", s.cast("int") + 1, (e - s).cast("int")), F.lit(">")).alias("reading"))
    wrong = F.struct(F.lit(30).alias("start"), F.lit(34).alias("end"), F.lit("no such").alias("base"), F.lit("!").alias("reading"))
    # a fixed span that reaches into the last one is left out, even where both start at one place
    fixed = F.filter(F.array(span(F.lit(2), F.lit(5)), wrong, span(F.lit(40), F.lit(44)), span(F.lit(300), F.lit(307))), lambda s: s.end <= n - 4)
    last = F.filter(F.array(span(n - 4, n - 1)), lambda s: s.start >= 0)
    return d.select("doc_id", S.replace_spans(F.col("t"), F.concat(fixed, last)).alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("h"))


def _marked(p):
    r = lambda s, e: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"))
    return p.select("page_id", S.highlight(F.col("t"), F.array(r(0, 10), r(20, 40))).alias("html"))


def q_highlight(spark, sf):
    return _marked(table(spark, sf, "pages").select("page_id", F.col("html").alias("t"))).select("page_id", F.length("html").alias("n"), F.md5("html").alias("h"))


def q_enclosing(spark, sf):
    s = spans_of(spark, sf)
    quotes = s.filter("flag = 'A'").select("chapter", "start", "end", F.col("id").alias("ord"))
    units = s.filter("flag <> 'A'").select("chapter", F.col("id").alias("unit"), "start", "end")
    return S.enclosing(quotes, units).select("unit", "quote")


def q_breaks(spark, sf):
    s = S.merge_ranges(spans_of(spark, sf)).withColumn("chunk", F.col("start"))
    b = spans_of(spark, sf).select("chapter", ((F.col("start") * 3) % 70).alias("pos"))
    return S.breaks_before_next(s, b)


def _continued(spark, sf, text):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("ord"), (F.col("role") == "user").alias("starts"), text.alias("text"))
    return S.merge_continuations(c).select("book", "ord", "text", "n")


def q_continuations(spark, sf):
    return _continued(spark, sf, F.col("text")).select("book", "ord", F.md5("text").alias("h"), "n")


def q_renumber(spark, sf):
    return S.renumber(spans_of(spark, sf), ["chapter"], ["start", "end", "id"]).select("chapter", "id", "index")


def q_valid(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chapter"), "text").withColumn("start", F.col("chapter").cast("int") % 50).withColumn("end", F.col("start") + 3)
    d = d.withColumn("base", F.when(F.col("chapter") % 4 == 0, "zzz").otherwise(F.substring("text", F.col("start") + 1, F.lit(3)))).withColumn("reading", F.when(F.col("chapter") % 5 == 0, " ").otherwise("x"))
    return S.valid(d).select("chapter", "start", "end", "base")


QUERIES = {
    "f16_highlight": q_highlight, "f40_replace_spans": q_replace, "j1_version": q_version, "j2_contained": q_contained, "j4_without_overlaps": q_without_overlaps, "j16_enclosing": q_enclosing, "j17_breaks": q_breaks, "p4_valid_spans": q_valid,
    "w10_coalesce": q_coalesce, "w11_merge_ranges": q_merge, "w12_greedy": q_greedy, "w12b_first_claims": q_claims, "w16_continuations": q_continuations, "w18_shift": q_shift, "w20_renumber": q_renumber,
}

_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_MERGED = f"""{_SPANS}, m0 AS (SELECT chapter, start, "end", id, max("end") OVER (PARTITION BY chapter ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chapter ORDER BY start, "end", id) AS run FROM m0), merged AS (SELECT chapter, min(start) AS start, max("end") AS "end" FROM m1 GROUP BY chapter, run)"""

ORACLES = {
    "f16_highlight": f"SELECT page_id, length(html) AS n, md5(html) AS h FROM (SELECT page_id, '<mark>' || {_ESC.format('substr(html, 1, 10)')} || '</mark>' || {_ESC.format('substr(html, 11, 10)')} || '<mark>' || {_ESC.format('substr(html, 21, 20)')} || '</mark>' || {_ESC.format('substr(html, 41)')} AS html FROM pages)",
    "f40_replace_spans": """WITH d AS (SELECT doc_id, text AS t, length(text) AS n, CASE WHEN length(text) >= 311 THEN 307 WHEN length(text) >= 48 THEN 44 WHEN length(text) >= 9 THEN 5 ELSE 0 END AS c FROM documents),
r AS (SELECT doc_id, CASE WHEN n >= 9 THEN substr(t, 1, 2) || '<' || substr(t, 3, 3) || '>' ELSE '' END || CASE WHEN n >= 48 THEN substr(t, 6, 35) || '<' || substr(t, 41, 4) || '>' ELSE '' END
  || CASE WHEN n >= 311 THEN substr(t, 45, 256) || '<' || substr(t, 301, 7) || '>' ELSE '' END || CASE WHEN n >= 4 THEN substr(t, c + 1, n - 4 - c) || '<' || substr(t, n - 3, 3) || '>' || substr(t, n, 1) ELSE t END AS x FROM d)
SELECT doc_id, length(x) AS n, md5(x) AS h FROM r""",
    "j1_version": f"""WITH {_SPANS} SELECT chapter, CASE o_custkey % 3 WHEN 0 THEN 'clean' ELSE 'raw' END AS version, count(*) AS n, CAST(sum(start) AS BIGINT) AS s FROM spans JOIN orders ON o_orderkey = chapter
WHERE o_custkey % 3 = 0 AND flag <> 'R' OR o_custkey % 3 = 1 AND flag = 'R' GROUP BY ALL""",
    "j2_contained": f"""WITH {_SPANS} SELECT chapter, CAST(start // 20 AS BIGINT) AS chunk, id, start % 20 AS start, "end" - start // 20 * 20 AS "end" FROM spans WHERE "end" <= (start // 20 + 1) * 20""",
    "j4_without_overlaps": f"""WITH {_SPANS} SELECT chapter, id FROM spans s WHERE flag <> 'R' AND NOT EXISTS (SELECT 1 FROM spans r WHERE r.flag = 'R' AND r.chapter = s.chapter AND s.start < r."end" AND s."end" > r.start)""",
    "j16_enclosing": f"""WITH {_SPANS}, b AS (SELECT u.id AS unit, q.id AS quote, row_number() OVER (PARTITION BY u.id ORDER BY q."end" - q.start DESC, q.id) AS rn FROM spans u LEFT JOIN spans q ON q.chapter = u.chapter AND q.flag = 'A' AND q.start <= u.start AND q."end" >= u."end" WHERE u.flag <> 'A')
SELECT unit, quote FROM b WHERE rn = 1""",
    "j17_breaks": f"""WITH {_MERGED}, n AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY chapter ORDER BY start), 1073741824) AS nxt FROM merged)
SELECT chapter, start AS chunk, EXISTS (SELECT 1 FROM spans b WHERE b.chapter = n.chapter AND (b.start * 3) % 70 >= n."end" AND (b.start * 3) % 70 < n.nxt) AS section_break FROM n""",
    "p4_valid_spans": """SELECT doc_id AS chapter, CAST(doc_id % 50 AS INT) AS start, CAST(doc_id % 50 + 3 AS INT) AS "end", substr(text, doc_id % 50 + 1, 3) AS base FROM documents
WHERE doc_id % 5 <> 0 AND length(text) >= doc_id % 50 + 3 AND (doc_id % 4 <> 0 OR substr(text, doc_id % 50 + 1, 3) = 'zzz')""",
    "w10_coalesce": """WITH c AS (SELECT DISTINCT l_orderkey % 200 AS chapter, l_partkey % 60 AS start FROM lineitem), s AS (SELECT * FROM c WHERE (start * 7 + chapter) % 3 > 0),
g AS (SELECT *, start - row_number() OVER (PARTITION BY chapter ORDER BY start) AS run FROM s)
SELECT chapter, min(start) AS start, max(start) + 1 AS "end", string_agg(chr(CAST(start % 26 + 97 AS INT)), '' ORDER BY start) AS base, string_agg(CAST(start % 10 AS VARCHAR), '' ORDER BY start) AS reading FROM g GROUP BY chapter, run HAVING count(*) > 1""",
    "w11_merge_ranges": f"""WITH {_MERGED} SELECT chapter, start, "end" FROM merged""",
    "w12_greedy": f"""WITH RECURSIVE {_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY start, "end", id) AS i FROM spans),
f AS (SELECT chapter, i, true AS taken, "end" AS at, id FROM o WHERE i = 1 UNION ALL SELECT o.chapter, o.i, o.start >= f.at, CASE WHEN o.start >= f.at THEN o."end" ELSE f.at END, o.id FROM f JOIN o ON o.chapter = f.chapter AND o.i = f.i + 1)
SELECT o.chapter, o.start, o."end", o.id FROM f JOIN o USING (chapter, i) WHERE taken""",
    "w12b_first_claims": f"""WITH RECURSIVE {_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY flag = 'R', start - "end", id) AS i FROM spans),
f AS (SELECT chapter, i, true AS taken, [{{'s': start, 'e': "end"}}] AS got, id FROM o WHERE i = 1
  UNION ALL SELECT chapter, i, free, CASE WHEN free THEN list_append(got, {{'s': start, 'e': "end"}}) ELSE got END, id FROM (SELECT o.chapter, o.i, o.id, o.start, o."end", f.got, len(list_filter(f.got, lambda x: x.s < o."end" AND o.start < x.e)) = 0 AS free FROM f JOIN o ON o.chapter = f.chapter AND o.i = f.i + 1))
SELECT o.chapter, o.start, o."end", o.id FROM f JOIN o USING (chapter, i) WHERE taken""",
    "w16_continuations": """WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations)
SELECT conv_id AS book, min(turn) AS ord, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS h, count(*) AS n FROM g GROUP BY conv_id, grp""",
    "w18_shift": "SELECT conv_id AS grp, turn AS ord, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations",
    "w20_renumber": f"""WITH {_SPANS} SELECT chapter, id, CAST(row_number() OVER (PARTITION BY chapter ORDER BY start, "end", id) AS INT) AS "index" FROM spans""",
}
