"""Queries of what chunks are read as: lines of documents are chunks, written in Japanese signs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import preparation as P
from textloom.plans.books import LATIN, SIGNS
from textloom.plans.common import literal_rows, table
from textloom.shared import written

_ENTRY = {"book": "string", "ord": "int", "base": "string", "pattern": "string", "reading": "string", "mode": "string"}
#: Signs of every step: dashes, quotes, ellipses, waves, numbers; what a line has in place of some of its ASCII signs.
_FROM, _TO = ".,;:-'\"!?", "。、「」―'”！…"


def chunks_of(spark, sf):
    """(book, chapter, chunk, start, end, text): lines of documents with their places."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("book"), F.col("doc_id").alias("chapter"), F.translate(F.lower("text"), LATIN, SIGNS).alias("t"))
    lines = d.select("book", "chapter", F.posexplode(F.split("t", "\n")).alias("chunk", "text"))
    w = Window.partitionBy("chapter").orderBy("chunk")
    return lines.withColumn("end", F.sum(F.length("text") + 1).over(w) - 1).withColumn("start", F.col("end") - F.length("text")).select("book", "chapter", "chunk", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


def spans_of(chunks):
    """The first two of every forty signs of a chapter, each with a reading: a row for each forty signs, not for each sign."""
    before = (F.col("start") % 40).cast("int")  # signs of the forty that stand before the chunk
    e = chunks.select("chapter", (F.col("start") - before).alias("at"), F.posexplode(F.regexp_extract_all(F.concat(F.repeat(F.lit("\n"), before), "text"), F.lit("(?s).{1,40}"), F.lit(0))).alias("k", "t"))
    two = e.select("chapter", (F.col("at") + 40 * F.col("k")).alias("at"), F.posexplode(F.array(F.substring("t", 1, 1), F.substring("t", 2, 1))).alias("i", "base")).filter("base NOT IN ('', '\n')")
    return two.select("chapter", (F.col("at") + F.col("i")).alias("start"), (F.col("at") + F.col("i") + 1).alias("end"), "base", F.lit("かな").alias("reading"))


def q_evidence(spark, sf):
    c = written(chunks_of(spark, sf))
    return P.ruby_evidence(c, spans_of(c)).select("chapter", "chunk", F.md5("text").alias("h"), F.length("text").alias("n"))


def q_prepared(spark, sf):
    """Lines of documents with signs of every step in them."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.translate(F.lower("text"), LATIN, SIGNS), "\n")).alias("i", "t"))
    t = F.regexp_replace(F.translate("t", _FROM, _TO), "、 ", "〜")
    return d.select("doc_id", "i", F.md5(P.prepare(t)).alias("h"), F.md5(P.prepare(t, short_stops=True, old="阪", new="坂")).alias("stops"))


def q_pipeline(spark, sf):
    c = written(chunks_of(spark, sf))
    book = literal_rows(spark, _ENTRY, [("en", 0, "木木", None, "モリ", None), ("en", 1, "東", None, "ひがし", None), ("de", 0, "大", None, "だい", "first")])
    own = literal_rows(spark, _ENTRY, [("en", 0, "東", None, "トウ", None), ("fr", 0, None, "([あいう])山", r"\1やま", None)])
    got = P.pipeline(c, spans_of(c), book, own)
    return got.select("chapter", "chunk", *(F.md5(x).alias(x) for x in ("ruby_text", "after_overrides", "after_numbers", "prepared")))


QUERIES = {"f29_prepared": q_prepared, "f30_pipeline": q_pipeline, "f42_ruby_evidence": q_evidence}

ORACLES = {
    "f42_ruby_evidence": f"""WITH l AS (SELECT doc_id AS chapter, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS chunk, unnest(string_split(translate(lower(text), '{LATIN}', '{SIGNS}'), chr(10))) AS t FROM documents),
p AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY chapter ORDER BY chunk) - 1 - length(t) AS start FROM l),
r AS (SELECT chapter, chunk, coalesce(array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN (start + i - 1) % 40 < 2 AND trim(c) <> '' THEN 'かな' ELSE c END), ''), '') AS t FROM p)
SELECT chapter, chunk, md5(t) AS h, CAST(length(t) AS INT) AS n FROM r""",
}
