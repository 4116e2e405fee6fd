"""Queries of the reading overrides: documents by language, conversations as chapters, entries made of parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import overrides as O
from textloom.plans.common import literal_rows, table

_ENTRIES = [
    ("en", 0, "th", None, "TH", None), ("en", 1, "the", None, "ザ", "all"), ("en", 2, "tion", None, "ション", "first"), ("en", 3, None, r"([aeiou])n([.,])", r"\1ン\2", None), ("en", 4, None, "([", "!", None),
    ("fr", 0, "eau", None, "オ", None), ("fr", 1, "eaux", None, "オー", None), ("es", 0, "el", None, "$1", "first"), ("es", 1, "qu", None, "", None),
]


def q_apply(spark, sf):
    entries = literal_rows(spark, {"lang": "string", "ord": "int", "base": "string", "pattern": "string", "reading": "string", "mode": "string"}, _ENTRIES)
    d = O.apply_overrides(table(spark, sf, "documents").select("doc_id", "lang", "text"), entries, ["lang"])
    return d.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("h"))


_FROM, _TO = "aeiount.", "帝山はだんア々。"


def q_boundaries(spark, sf):
    t, base, reading = F.translate("text", _FROM, _TO), F.lit("帝"), F.lit("ミカド")
    return table(spark, sf, "documents").select("doc_id", F.md5(O.replace_isolated(t, base, reading)).alias("isolated"), F.md5(O.replace_at_kanji_boundary(t, base, reading)).alias("kanji"))


def _surfaces(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chapter"), "text")
    before = Window.partitionBy("chapter").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    words = c.select("chapter", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    tokens = words.withColumn("start", F.coalesce(F.sum(F.length("w") + 1).over(before), F.lit(0))).select("chapter", "start", (F.col("start") + F.length("w")).alias("end"))
    spans = c.select("chapter", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 5, F.lit(0)), F.lit(37))).alias("id")).select("chapter", "id", F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
    return c, O.surfaces(c, spans, tokens)


def q_surfaces(spark, sf):
    return _surfaces(spark, sf)[1].select("chapter", "id", "surface")


def q_context_counts(spark, sf):
    c, s = _surfaces(spark, sf)
    pairs = s.join(c, "chapter").select(F.substring("text", F.col("start") + 1, F.lit(2)).alias("base"), "surface", F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("reading"))
    return O.context_counts(pairs, [])


def q_classes(spark, sf):
    return O.normal_classes(table(spark, sf, "events").select("user_id", F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("key")), ["user_id"], "key")


def _raw(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    base = F.when(size % 5 == 0, F.concat(F.lit("RE: "), "p_name")).when(size % 5 == 1, F.concat(F.lit("regex:"), "p_brand")).when(size % 5 == 2, "").when(size % 5 == 3, " re: ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    mode = F.element_at(F.array(*map(F.lit, (" ALL", "Once", "boundary", "kanji-boundary", "x"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    raw = p.select("p_partkey", "p_type", base.alias("base"), F.when(size % 7 == 0, F.col("p_type")).alias("pattern"), F.when(size % 11 > 2, F.col("p_brand")).alias("reading"), F.when(size % 2 == 0, F.col("p_type")).alias("kana"), (size % 13 == 0).alias("regex"), mode.alias("mode"))
    return O.parse_entries(raw)


def q_entries(spark, sf):
    return _raw(spark, sf).select("p_partkey", "base", "pattern", "reading", "mode")


def q_entries_text(spark, sf):
    return O.entries_text(_raw(spark, sf).withColumnRenamed("p_partkey", "ord"), ["p_type"])


def q_comments(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("\n- "), "p_name", F.lit(" = "), "p_brand", F.lit("  \r\n #"), "p_type", F.lit("\n\n"))
    given = F.array(F.col("p_type"), F.concat("p_name", F.lit("="), "p_brand"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit(" "), "p_brand")).otherwise(""), F.when(F.col("p_size") % 3 > 1, F.col("p_name")).otherwise(" "))
    return p.select("p_partkey", O.add_comments(text, given).alias("text"))


_TOKENS = """
c AS (SELECT conv_id || ':' || turn AS chapter, text FROM conversations),
w AS (SELECT chapter, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM c),
tokens AS (SELECT chapter, s AS t_start, s + length(w) AS t_end FROM (SELECT chapter, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY chapter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)),
spans AS (SELECT chapter, text, CAST(unnest(generate_series(0, greatest(length(text) - 5, 0), 37)) AS INT) AS id FROM c),
reach AS (SELECT s.chapter, id, min(t_start) AS lo, max(t_end) AS hi FROM spans s JOIN tokens t ON s.chapter = t.chapter AND t_start < id + 5 AND t_end > id AND t_end > t_start GROUP BY ALL),
surfaces AS (SELECT chapter, id, text, CASE WHEN id + 5 > length(text) THEN '' ELSE coalesce(nullif(regexp_replace(substr(text, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)), '^\\s+|\\s+$', '', 'g'), ''),
  regexp_replace(substr(text, id + 1, 5), '^\\s+|\\s+$', '', 'g')) END AS surface FROM spans LEFT JOIN reach USING (chapter, id))
"""

_RAW = """
raw AS (SELECT p_partkey, p_type, CASE p_size % 5 WHEN 0 THEN 'RE: ' || p_name WHEN 1 THEN 'regex:' || p_brand WHEN 2 THEN '' WHEN 3 THEN 're:' ELSE p_name END AS base, CASE WHEN p_size % 7 = 0 THEN p_type END AS given,
  CASE WHEN p_size % 11 > 2 THEN p_brand WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS reading, p_size % 13 = 0 AS regex, CASE p_partkey % 5 WHEN 1 THEN 'first' WHEN 2 THEN 'isolated' WHEN 3 THEN 'kanji' END AS mode, p_size FROM part),
parsed AS (SELECT *, CASE WHEN given IS NOT NULL THEN given WHEN regex AND base <> '' THEN base WHEN p_size % 5 = 0 THEN substr(base, 5) WHEN p_size % 5 = 1 THEN substr(base, 7) END AS pattern FROM raw WHERE reading <> ''),
entries AS (SELECT p_partkey, p_type, CASE WHEN pattern IS NULL THEN base END AS base, pattern, reading, CASE WHEN pattern IS NULL THEN mode END AS mode FROM parsed WHERE pattern IS NOT NULL OR p_size % 5 = 4)
"""

def q_files(spark, sf):
    """Override files written as JSON from parts, a file a brand, in several forms; and read again."""
    p = table(spark, sf, "part").filter("p_brand IS NOT NULL").select(F.col("p_brand").alias("book"), F.concat(F.lit("c"), (F.col("p_size") % 5).cast("string")).alias("chapter"), F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 7 == 0, F.substring("p_name", 1, 1)).otherwise(F.concat(F.lit(" "), "p_name")).alias("base"), F.col("p_type").alias("reading"), F.when(F.col("p_size") % 3 == 0, "once").alias("mode"))
    w = Window.partitionBy("book", "chapter").orderBy("k")
    rows = p.withColumn("ord", F.row_number().over(w) - 1)
    entry = F.array_sort(F.collect_list(F.struct("ord", "base", "reading", "mode")))
    lists = rows.groupBy("book", "chapter").agg(F.transform(entry, lambda e: F.struct(e.base.alias("base"), e.reading.alias("reading"), e["mode"].alias("mode"))).alias("entries"))
    # a file's c0 is the whole book's list, as pairs where the brand's number is even
    pairs = F.transform("entries", lambda e: F.array(e.base, e.reading))
    even = F.substring("book", -1, 1).isin("0", "2", "4", "6", "8")
    files = lists.groupBy("book").agg(
        F.max(F.when((F.col("chapter") == "c0") & even, F.to_json(pairs))).alias("pairs"), F.max(F.when((F.col("chapter") == "c0") & ~even, F.to_json(F.struct(F.col("entries").alias("replacements"))))).alias("list"),
        F.map_from_entries(F.collect_list(F.when(F.col("chapter") != "c0", F.struct("chapter", "entries")))).alias("chapters"),
    )
    body = F.when(F.coalesce("pairs", "list").isNull(), F.to_json("chapters")).otherwise(F.concat(F.lit('{"default": '), F.coalesce("pairs", "list"), F.lit(', "chapters": '), F.to_json("chapters"), F.lit("}")))
    return O.book_overrides(files.select("book", body.alias("data"))).select("book", "chapter", F.col("ord").cast("int").alias("ord"), "base", "reading", "mode")


QUERIES = {
    "s19_override_files": q_files,
    "j5_apply_overrides": q_apply, "f41_boundaries": q_boundaries, "j8_surfaces": q_surfaces, "a2_context_counts": q_context_counts, "a14_normal_classes": q_classes, "s21_entries": q_entries, "f48_entries_text": q_entries_text,
    "j20_add_comments": q_comments,
}

ORACLES = {
    "s19_override_files": """WITH p AS (SELECT p_brand AS book, 'c' || p_size % 5 AS chapter, p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN p_name[1] ELSE trim(p_name) END AS base, p_type AS reading, CASE WHEN p_size % 3 = 0 THEN 'first' END AS mode FROM part),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY book, chapter ORDER BY k) - 1 AS INT) AS ord, CAST(right(book, 1) AS INT) % 2 = 0 AND chapter = 'c0' AS pair FROM p)
SELECT book, CASE WHEN chapter <> 'c0' THEN chapter END AS chapter, ord, base, reading, CASE WHEN NOT pair AND mode IS NOT NULL THEN mode WHEN length(base) = 1 THEN 'isolated' END AS mode FROM r""",
    "j5_apply_overrides": r"""WITH t AS (SELECT doc_id, CASE lang
  WHEN 'en' THEN regexp_replace(replace(replace(CASE WHEN strpos(text, 'tion') > 0 THEN substr(text, 1, strpos(text, 'tion') - 1) || 'ション' || substr(text, strpos(text, 'tion') + 4) ELSE text END, 'the', 'ザ'), 'th', 'TH'), '([aeiou])n([.,])', '\1ン\2', 'g')
  WHEN 'fr' THEN replace(replace(text, 'eaux', 'オー'), 'eau', 'オ')
  WHEN 'es' THEN CASE WHEN strpos(text, 'el') > 0 THEN substr(text, 1, strpos(text, 'el') - 1) || '$1' || substr(text, strpos(text, 'el') + 2) ELSE text END ELSE text END AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INT) AS n, md5(t) AS h FROM t""",
    "f41_boundaries": f"""WITH t AS (SELECT doc_id, string_split(translate(text, '{_FROM}', '{_TO}'), '') AS cs FROM documents),
c AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM t),
n AS (SELECT *, coalesce(lag(c) OVER w, '') AS p, coalesce(lead(c) OVER w, '') AS n, coalesce(lead(c, 2) OVER w, '') AS nn FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, ((n = 'だ' AND p NOT IN ('帝', '山')) OR (p NOT IN ('帝', '山', 'だ', 'ん', 'ア') AND n NOT IN ('帝', '山', 'だ', 'ん', 'ア'))) AND NOT (n = 'は' AND nn IN ('は', 'だ', 'ん')) AS alone FROM n)
SELECT d.doc_id, coalesce(isolated, CASE WHEN text = '' THEN md5('') END) AS isolated, coalesce(kanji, CASE WHEN text = '' THEN md5('') END) AS kanji FROM documents d LEFT JOIN (
  SELECT doc_id, md5(string_agg(CASE WHEN c = '帝' AND alone THEN 'ミカド' ELSE c END, '' ORDER BY i)) AS isolated,
    md5(string_agg(CASE WHEN c = '帝' AND p NOT IN ('帝', '山', '々') AND n NOT IN ('帝', '山', '々') THEN 'ミカド' ELSE c END, '' ORDER BY i)) AS kanji FROM f GROUP BY doc_id) USING (doc_id)""",
    "j8_surfaces": f"WITH {_TOKENS} SELECT chapter, id, surface FROM surfaces",
    "a2_context_counts": f"WITH {_TOKENS} SELECT substr(text, id + 1, 2) AS base, surface, 'r' || (id % 3) AS reading, count(*) AS n FROM surfaces GROUP BY ALL",
    "a14_normal_classes": """WITH k AS (SELECT user_id, event_type || (event_id % 4) AS key, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM k)
SELECT user_id, key, n FROM m WHERE most < 8 OR n >= greatest(3, most // 5)""",
    "s21_entries": f"WITH {_RAW} SELECT p_partkey, base, pattern, reading, mode FROM entries",
    "f48_entries_text": f"WITH {_RAW} SELECT p_type, string_agg(CASE WHEN pattern IS NOT NULL THEN 're:' || pattern ELSE base END || '=' || reading, chr(10) ORDER BY p_partkey) AS text FROM entries GROUP BY p_type",
    "j20_add_comments": r"""SELECT p_partkey, '- ' || p_name || ' = ' || p_brand || chr(10) || ' #' || p_type || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || '# ' || p_brand ELSE chr(10) || chr(10) || '# ' || p_brand || chr(10) || '# ' || p_name END AS text FROM part""",
}
