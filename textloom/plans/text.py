"""Queries of the text functions over documents, conversations, pages and parts, and over fixtures of Japanese text."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dictionary, sections
from textloom.plans.common import table

DROP = ["widget$", "^(red|blue) ", "bolt"]
CUT = [r"^All rights reserved", r"\bidiot\b", "Licensed under"]
REMOVE = [r"[$%&*#]{3}", r"\d+", "the "]

#: Letters as Japanese signs, as in plans/books.py: consonants as kanji, vowels as kana of both kinds.
_LATIN, _SIGNS = "bcdfghjklmnpqrstvwxzaeiouy.", "木本東京大阪山川田中水火土金月日人口手足アいウえおヤ。"
_ELLIPSES = "CASE WHEN length(t) % 10 = 0 THEN repeat('…', CAST(1 + length(t) % 9 AS INT)) ELSE replace(t, ', ', '……⋯') END"


def q_japanese(spark, sf):
    """Words of documents in Japanese signs, by script, in both kana, with stops, and with short ellipses."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.translate(F.lower("text"), _LATIN, _SIGNS), "\n")).alias("i", "t"))
    t, e = F.col("t"), F.expr(_ELLIPSES)
    word = F.element_at(F.split(t, " "), 1)
    return d.select("doc_id", "i", T.script(word).alias("script"), F.md5(T.to_hiragana(t)).alias("hiragana"), F.md5(T.to_katakana(t)).alias("katakana"), F.md5(T.tail_stop(t)).alias("tail"), F.md5(T.short_ellipsis(e)).alias("ellipsis"), T.ellipsis_pause(e).alias("pause"))


def q_clean(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("  “[t]he”  "), F.replace(F.col("text"), F.lit(". "), F.lit(".  \r\n")), F.lit(" . . .")).alias("t"))
    return d.select("doc_id", F.md5(T.clean(F.col("t"))).alias("h"), F.length(T.clean(F.col("t"))).alias("n"))


def q_reader(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit(" ‘"), F.replace(F.col("text"), F.lit(", "), F.lit("  \t\r\n"))).alias("t"))
    return d.select("conv_id", "turn", F.md5(T.clean_reader(F.col("t"))).alias("h"))


def q_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.title_of(F.concat(F.lit("\n \n"), F.col("text"))).alias("title"))


def q_markdown(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n## "), F.col("text"))).otherwise(F.col("text"))
    path = F.concat(F.lit("/books/"), F.col("conv_id").cast("string"), F.lit("_my-"), F.col("role"), F.lit(".v1.txt"))
    return c.select("conv_id", "turn", T.markdown_title(t).alias("title"), T.filename_title(path).alias("name"))


def q_drop(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.drop_reason(F.col("p_name"), DROP).alias("reason"))


def q_cutoff(spark, sf):
    cut, why = T.cutoff(F.col("text"), CUT)
    return table(spark, sf, "documents").select("doc_id", F.md5(cut).alias("h"), F.length(cut).alias("n"), why.alias("why"))


def q_remove(spark, sf):
    out, counts = T.remove_all(F.col("text"), REMOVE)
    return table(spark, sf, "documents").select("doc_id", F.md5(out).alias("h"), *(c.alias(f"n{i}") for i, c in enumerate(counts)))


def q_removal_totals(spark, sf):
    """Matches per pattern over all documents, and documents that a cutoff shortens."""
    _, counts = T.remove_all(F.col("text"), REMOVE)
    cut, why = T.cutoff(F.col("text"), CUT)
    d = table(spark, sf, "documents").select(*(c.alias(f"n{i}") for i, c in enumerate(counts)), (why != "").cast("int").alias("cut"))
    return d.agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(REMOVE))), F.sum("cut").alias("cut"), F.count(F.lit(1)).alias("total"))


def q_lines(spark, sf):
    """Lines of documents by kind."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    x = F.col("x")
    return d.groupBy("doc_id").agg(F.count_if(T.is_symbolic(x)).alias("symbolic"), F.count_if(T.has_bracket(x)).alias("bracket"), F.count_if(T.is_note_marker(x)).alias("notes"))


def q_words(spark, sf):
    """Words of documents in capitals, and the words without a lower-case letter among them."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("w"))
    return d.groupBy("doc_id").agg(F.count_if(T.is_all_caps(F.col("w"))).alias("caps"), F.count_if(~F.col("w").rlike(r"\p{Ll}")).alias("no_lower"))


def q_filename(spark, sf):
    p = table(spark, sf, "part")
    title = F.when(F.col("p_size") < 10, F.lit(" ")).when(F.col("p_size") < 20, F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).when(F.col("p_size") < 30, F.concat(F.upper("p_name"), F.lit(".HTML"))).otherwise(F.upper("p_name"))
    return p.select("p_partkey", T.looks_like_filename(title, F.concat(F.lit("text/"), F.col("p_name"), F.lit(".xhtml"))).alias("filename"), T.is_non_content(F.when(F.col("p_size") % 3 == 0, " TOC ").otherwise(F.col("p_name"))).alias("non_content"))


def q_markers(spark, sf):
    p = table(spark, sf, "part")
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("x-ttl"), F.col("p_size").cast("string"))).when(F.col("p_size") % 4 == 1, "SubTitle").when(F.col("p_size") % 4 == 2, "shd").otherwise("hd_1")
    head = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("第"), F.col("p_size").cast("string"), F.lit("章 "), F.col("p_name"))).when(F.col("p_size") % 3 == 1, "Prologue").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("th")))
    return p.select("p_partkey", T.is_heading_marker(name).alias("marker"), T.is_structural(head).alias("structural"))


def q_suspicious(spark, sf):
    p = table(spark, sf, "part")
    base = F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name"))
    reading = F.when(F.col("p_size") % 3 == 0, "漢かな").when(F.col("p_size") % 7 == 0, F.repeat(F.lit("か"), F.col("p_size"))).otherwise("よみ")
    return p.select("p_partkey", T.is_suspicious(base, reading).alias("bad"))


def q_meta(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat(F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit(",,\n "), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", F.array_join(T.authors(text), "|").alias("authors"), T.metadata_escape(F.concat(F.col("c_name"), F.lit("=;x\n"))).alias("escaped"), T.chapter_id(F.col("c_custkey"), F.col("c_name")).alias("id"), F.sha2(F.col("c_name"), 256).alias("sha"))


def q_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.is_http_url(F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))).alias("http"), F.parse_url("url", F.lit("HOST")).alias("host"))


def q_case_map(spark, sf):
    """For each word with a lower-case letter its commonest spelling; ties by Title, lower, other, then the first seen."""
    d = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("pos", "w"))
    score = F.when(F.col("w").rlike("^[A-Z][a-z]*$"), 3).when(F.col("w").rlike("^[a-z]+$"), 2).otherwise(1)
    n = d.filter(F.col("w").rlike("[a-z]")).groupBy(F.lower("w").alias("key"), "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return n.groupBy("key").agg(F.min_by("w", F.struct(-F.col("n"), -score, "first")).alias("spelling")).filter("key <> spelling")


def q_section_markers(spark, sf):
    """Lines of symbols that mark sections: common ones that mostly stand alone, and whose signs are rare in the rest of the text."""
    from pyspark.sql import Window

    base = table(spark, sf, "conversations").select((F.col("conv_id") % 20).alias("doc"), "conv_id", "turn", "text")
    lines = base.select("doc", F.posexplode(F.split(F.concat("text", F.when(F.col("turn") % 2 == 0, "\n\n***\n").otherwise("\n.\n--\n")), "\n")).alias("p", "x"), "conv_id", "turn").withColumn("x", F.trim("x"))
    w = Window.partitionBy("doc").orderBy("conv_id", "turn", "p")
    own = lines.withColumn("candidate", T.is_symbolic(F.col("x"))).withColumn("before", F.lag("x").over(w)).withColumn("after", F.lead("x").over(w))
    alone = ((F.coalesce("before", F.lit("")) == "") & (F.coalesce("after", F.lit("")) == "")).cast("int")
    cand = own.filter("candidate").groupBy("doc", "x").agg(F.count(F.lit(1)).alias("n"), F.sum(alone).alias("alone"))
    chars = own.filter("NOT candidate").select("doc", F.explode(F.split("x", "")).alias("c")).groupBy("doc", "c").agg(F.count(F.lit(1)).alias("k"))
    signs = cand.select("doc", "x", F.explode(F.split("x", "")).alias("c")).filter("c <> ''").join(chars, ["doc", "c"], "left").groupBy("doc", "x").agg(F.sum(F.coalesce("k", F.lit(0))).alias("embedded"))
    out = cand.join(signs, ["doc", "x"])
    return out.select("doc", F.col("x").alias("marker"), "n", "alone", "embedded", (~T.has_bracket(F.col("x")) & (F.col("embedded") <= 0.35 * F.col("n") * F.length("x")) & (F.col("n") >= 2) & (F.col("alone") >= 0.8 * F.col("n"))).alias("is_marker"))


def sections_of(spark, sf):
    """Documents with lines of signs between their lines: some alone, some in runs, some beside text."""
    line = F.split("text", "\n")
    sign = lambda x, i: F.when((F.length(x) + i) % 6 == 0, F.concat(x, F.lit("\n\n***\n\n"))).when((F.length(x) + i) % 6 == 1, F.concat(x, F.lit("\n--\n"))).when((F.length(x) + i) % 6 == 2, F.concat(x, F.lit("\n \n# #\n# #\n"))).when(F.length(x) % 31 == 0, F.concat(x, F.lit("\n\n†\n\n"))).otherwise(x)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.array_join(F.transform(line, sign), "\n").alias("text"))


def q_sections(spark, sf):
    return sections.with_sections(sections_of(spark, sf)).select(F.col("doc").alias("doc_id"), F.md5("text").alias("h"), F.regexp_count("text", F.lit(T.SECTION)).alias("n"))


def q_folders(spark, sf):
    """Books named by their language and kind, with signs that folders can't have."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("book"), F.concat(F.lit(" ..a/"), "lang", F.lit('?: "'), "source", F.lit("\t*. ")).alias("title"))
    return dictionary.unique_folders(d)


_KNOWN = {"der": "DeR", "the": "THe", "que": "Que", "and": "and"}


def q_capitals(spark, sf):
    """Lines of documents in capitals, those of even length as headings."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("ß"), F.lit("ss")), "\n")).alias("i", "line"))
    line = F.when(F.length("line") % 5 > 0, F.upper("line")).otherwise(F.col("line"))
    known = F.create_map(*(F.lit(x) for kv in _KNOWN.items() for x in kv))
    return d.select("doc_id", "i", F.md5(T.repair_capitals(line, F.length("line") % 2 == 0, known)).alias("h"))


def q_css(spark, sf):
    """Style sheets with the words of a page's title as class names, by turns with a heading's ending."""
    words = F.regexp_extract_all("html", F.lit("<title>([^<]*)</title>"), F.lit(1))
    names = F.transform(F.split(F.coalesce(F.get(words, F.lit(0)), F.lit("")), " "), lambda w: F.concat(F.lit("x"), F.regexp_replace(w, "[^A-Za-z]", "")))
    rule = F.transform(names, lambda n, i: F.concat(F.when(i % 2 == 0, ".").otherwise("#"), n, F.when(i % 3 == 0, "-ttl").when(i % 3 == 1, "Title").otherwise(""), F.lit(" > p { margin: 0 }")))
    css = F.concat(F.lit("/* .title {} */"), F.array_join(rule, "\n"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(T.css_markers(css)), "|").alias("markers"))


def _md5(sql: str) -> str:
    return f"md5({sql})"


_CUTS = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?im){p}') THEN {i}" for i, p in enumerate(CUT)) + " ELSE 9 END"
_CUT_TEXT = "CASE k " + " ".join(f"WHEN {i} THEN rtrim(substr(text, 1, strpos(text, regexp_extract(text, '(?im){p}')) - 1), ' ' || chr(9) || chr(10) || chr(13))" for i, p in enumerate(CUT)) + " ELSE text END"
_R0, _R1, _R2 = REMOVE
_REMOVED = f"""r AS (SELECT doc_id, text AS t0, regexp_replace(text, '{_R0}', '', 'g') AS t1 FROM documents), r2 AS (SELECT *, regexp_replace(t1, '{_R1}', '', 'g') AS t2 FROM r), r3 AS (SELECT *, regexp_replace(t2, '{_R2}', '', 'gi') AS t3 FROM r2),
c AS (SELECT doc_id, t3, len(regexp_extract_all(t0, '{_R0}')) AS n0, len(regexp_extract_all(t1, '{_R1}')) AS n1, len(regexp_extract_all(t2, '(?i){_R2}')) AS n2 FROM r3)"""

QUERIES = {
    "f4_sections": q_sections, "f7_folders": q_folders,
    "a11_case_map": q_case_map, "a12_section_markers": q_section_markers, "a15_removal_totals": q_removal_totals, "f1_clean": q_clean, "f9_capitals": q_capitals, "f17_f28_japanese": q_japanese, "f49_f51_metadata": q_meta, "f53_urls": q_url, "o7_title": q_title, "p1_drop_reason": q_drop,
    "p2_cutoff": q_cutoff, "p3_remove": q_remove, "p5_suspicious": q_suspicious, "p6_p7_lines": q_lines, "p8_p9_titles": q_filename, "p10_p11_markers": q_markers, "p21_caps": q_words, "s7_titles": q_markdown, "s10_reader": q_reader, "s26_css_markers": q_css,
}

ORACLES = {
    "f7_folders": """WITH d AS (SELECT doc_id AS book, 'a ' || lang || ' ' || source || ' ' AS f FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY book) AS n FROM d) SELECT book, CASE WHEN n = 1 THEN f ELSE f || '-' || n END AS folder FROM n""",
    "f9_capitals": r"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS i, unnest(string_split(replace(text, 'ß', 'ss'), chr(10))) AS line FROM documents),
u AS (SELECT doc_id, i, CASE WHEN length(line) % 5 > 0 THEN upper(line) ELSE line END AS line, length(line) % 2 = 0 AS heading FROM l)
SELECT doc_id, i, md5(CASE WHEN regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}') THEN array_to_string(list_transform(string_split(line, ' '), lambda w, k:
  CASE WHEN map_contains(MAP {KNOWN}, lower(w)) THEN CASE WHEN k = 1 THEN upper(MAP {KNOWN}[lower(w)][1]) || MAP {KNOWN}[lower(w)][2:] ELSE MAP {KNOWN}[lower(w)] END
    WHEN list_contains(['SMALL'], lower(w)) THEN CASE WHEN k = 1 THEN upper(w[1]) || lower(w[2:]) ELSE lower(w) END
    WHEN regexp_full_match(w, '[IVXLCDM]+') OR length(w) <= 3 THEN w WHEN heading OR k = 1 THEN upper(w[1]) || lower(w[2:]) ELSE lower(w) END), ' ') ELSE line END) AS h FROM u""".replace("KNOWN", str(_KNOWN)[1:-1]).replace("SMALL", "', '".join(T.SMALL_WORDS)),
    "s26_css_markers": r"""WITH w AS (SELECT page_id, list_transform(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' '), lambda x: 'x' || regexp_replace(x, '[^A-Za-z]', '', 'g')) AS ws FROM pages),
n AS (SELECT page_id, lower(CASE WHEN i % 2 = 0 THEN '.' ELSE '#' END || ws[i + 1] || CASE i % 3 WHEN 0 THEN '-ttl' WHEN 1 THEN 'Title' ELSE '' END) AS m FROM (SELECT page_id, ws, unnest(range(0, len(ws))) AS i FROM w))
SELECT page_id, coalesce(string_agg(DISTINCT m, '|' ORDER BY m) FILTER (regexp_matches(m, 'title|chapter|section|headline|heading|midashi|-ttl$')), '') AS markers FROM n GROUP BY page_id""",
    "f17_f28_japanese": rf"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS i, unnest(string_split(translate(lower(text), '{_LATIN}', '{_SIGNS}'), chr(10))) AS t FROM documents),
x AS (SELECT *, string_split(t, ' ')[1] AS w, {_ELLIPSES} AS e, rtrim(t) AS r FROM l)
SELECT doc_id, i, CASE WHEN regexp_full_match(w, '[{_SIGNS[:20]}]+') THEN 'kanji' WHEN regexp_full_match(w, '[いえお]+') THEN 'hiragana' WHEN regexp_full_match(w, '[アウヤ]+') THEN 'katakana' WHEN regexp_full_match(w, '[アウヤいえお]+') THEN 'kana' WHEN regexp_matches(w, '[{_SIGNS[:26]}]') THEN 'mixed' ELSE 'other' END AS script,
  md5(translate(t, 'アウヤ', 'あうや')) AS hiragana, md5(translate(t, 'いえお', 'イエオ')) AS katakana,
  md5(CASE WHEN regexp_matches(t, '[{_SIGNS[:26]}]') AND r <> '' AND NOT regexp_matches(r, '[。！？!?…、，,;；:：][」』】）)］〉》”’\]]*$') THEN r || '。' || substr(t, length(r) + 1) ELSE t END) AS tail,
  md5(regexp_replace(e, '[…⋯]{{3,}}', '⋯', 'g')) AS ellipsis, CAST(CASE WHEN regexp_full_match(regexp_replace(e, '["“”‘’「」『』\s]', '', 'g'), '[…⋯]+') THEN least(1200, 380 + 120 * (length(regexp_replace(e, '["“”‘’「」『』\s]', '', 'g')) - 1)) ELSE 0 END AS INT) AS pause FROM x""",
    "f1_clean": r"""WITH d AS (SELECT doc_id, '  “[t]he”  ' || replace(text, '. ', '.  ' || chr(13) || chr(10)) || ' . . .' AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(t, '“', '"'), '”', '"'), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g') AS t FROM d),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(t, '"[t]he', '"the'), '-\n([\p{L}\p{N}_])', '-\1', 'g'), '[ \t]{2,}', ' ', 'g'), '\.[ \t]*\.[ \t]*\.', '...', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM b) SELECT doc_id, md5(t) AS h, CAST(length(t) AS INT) AS n FROM c""",
    "s10_reader": r"""WITH d AS (SELECT conv_id, turn, ' ‘' || replace(text, ', ', '  ' || chr(9) || chr(13) || chr(10)) AS t FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(t, '‘’', ''''''), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS h FROM d""",
    "o7_title": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS x FROM documents)
SELECT doc_id, CASE WHEN x IS NULL THEN '' WHEN length(x) > 40 THEN rtrim(substr(x, 1, 40)) || '...' ELSE x END AS title FROM l""",
    "s7_titles": """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(coalesce(list_filter(string_split('## ' || text, chr(10)), lambda x: trim(x) <> '')[1][3:], '')) ELSE '' END AS title, 'my ' || role || '.v1' AS name FROM conversations""",
    "p1_drop_reason": "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name, '(?i){p}') THEN '{p}'" for p in DROP) + " ELSE '' END AS reason FROM part",
    "p2_cutoff": f"WITH k AS (SELECT doc_id, text, {_CUTS} AS k FROM documents), c AS (SELECT doc_id, k, {_CUT_TEXT} AS t FROM k) SELECT doc_id, md5(t) AS h, CAST(length(t) AS INT) AS n, CASE k " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(CUT)) + " ELSE '' END AS why FROM c",
    "p3_remove": f"WITH {_REMOVED} SELECT doc_id, md5(t3) AS h, CAST(n0 AS INT) AS n0, CAST(n1 AS INT) AS n1, CAST(n2 AS INT) AS n2 FROM c",
    "a15_removal_totals": f"WITH {_REMOVED} SELECT CAST(sum(n0) AS BIGINT) AS n0, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2, (SELECT count(*) FROM documents WHERE {_CUTS} < 9) AS cut, count(*) AS total FROM c",
    "p6_p7_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, count(*) FILTER (trim(x) <> '' AND NOT regexp_matches(x, '[\p{L}\p{N}\p{M}]')) AS symbolic, count(*) FILTER (regexp_matches(x, '[\p{Ps}\p{Pe}\p{Pi}\p{Pf}]')) AS bracket, count(*) FILTER (regexp_matches(trim(x), '(?i)^\d{1,4}[a-z]?[.)]?$')) AS notes FROM l GROUP BY doc_id""",
    "p21_caps": r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM documents)
SELECT doc_id, count(*) FILTER (regexp_matches(w, '\p{L}') AND NOT regexp_matches(w, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]')) AS caps, count(*) FILTER (NOT regexp_matches(w, '\p{Ll}')) AS no_lower FROM l GROUP BY doc_id""",
    "p8_p9_titles": "SELECT p_partkey, p_size < 30 OR lower(upper(p_name)) = p_name AS filename, p_size % 3 = 0 AS non_content FROM part",
    "p10_p11_markers": "SELECT p_partkey, p_size % 4 <> 2 AS marker, p_size % 3 <> 2 AS structural FROM part",
    "p5_suspicious": "SELECT p_partkey, p_size % 5 = 0 OR p_size % 3 = 0 OR (p_size % 7 = 0 AND p_size > greatest(24, 6 * length(p_name))) AS bad FROM part",
    "f49_f51_metadata": """SELECT c_custkey, c_name || '|' || c_mktsegment || '|' || c_nationkey AS authors, replace(c_name, '#', chr(92) || '#') || chr(92) || '=' || chr(92) || ';x' || chr(92) || chr(10) AS escaped,
lpad(CAST(c_custkey AS VARCHAR), 4, '0') || '-' || replace(lower(c_name), '#', '-') AS id, sha256(c_name) AS sha FROM customer""",
    "f53_urls": r"SELECT page_id, page_id % 3 <> 0 AS http, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages",
    "a11_case_map": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents WHERE lang = 'en'), p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM w),
n AS (SELECT lower(w) AS key, w, count(*) AS n, min(doc_id * 1000000 + pos) AS f FROM p WHERE regexp_matches(w, '[a-z]') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, CASE WHEN regexp_matches(w, '^[A-Z][a-z]*$') THEN 3 WHEN regexp_matches(w, '^[a-z]+$') THEN 2 ELSE 1 END DESC, f) AS rn FROM n) SELECT key, w AS spelling FROM r WHERE rn = 1 AND w <> key""",
    "a12_section_markers": r"""WITH b AS (SELECT conv_id % 20 AS doc, conv_id, turn, string_split(text || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '***' || chr(10) ELSE chr(10) || '.' || chr(10) || '--' || chr(10) END, chr(10)) AS ls FROM conversations),
l AS (SELECT doc, conv_id, turn, trim(unnest(ls)) AS x, generate_subscripts(ls, 1) AS p FROM b),
o AS (SELECT *, x <> '' AND NOT regexp_matches(x, '[\p{L}\p{N}\p{M}]') AS cand, coalesce(lag(x) OVER v, '') = '' AND coalesce(lead(x) OVER v, '') = '' AS alone FROM l WINDOW v AS (PARTITION BY doc ORDER BY conv_id, turn, p)),
c AS (SELECT doc, x, count(*) AS n, count(*) FILTER (alone) AS alone FROM o WHERE cand GROUP BY doc, x),
k AS (SELECT doc, c, count(*) AS k FROM (SELECT doc, unnest(string_split(x, '')) AS c FROM o WHERE NOT cand) GROUP BY doc, c),
e AS (SELECT s.doc, s.x, sum(coalesce(k.k, 0)) AS embedded FROM (SELECT doc, x, unnest(string_split(x, '')) AS c FROM c) s LEFT JOIN k ON k.doc = s.doc AND k.c = s.c WHERE s.c <> '' GROUP BY s.doc, s.x)
SELECT c.doc, c.x AS marker, n, alone, CAST(embedded AS BIGINT) AS embedded, NOT regexp_matches(c.x, '[\p{Ps}\p{Pe}\p{Pi}\p{Pf}]') AND embedded <= 0.35 * n * length(c.x) AND n >= 2 AND alone >= 0.8 * n AS is_marker FROM c JOIN e USING (doc, x)""",
}
