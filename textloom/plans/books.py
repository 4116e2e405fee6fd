"""Queries of chapters of books, spans through cleaning, layers of spans, and pauses: hosts of pages are books, documents and conversations are chapters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from textloom import sinks
from textloom.functions import html
from textloom.functions import text as T
from textloom.operators import casing, chapters, sanitise, tracking
from textloom.operators import spans as S
from textloom.plans.common import table
from textloom.shared import shared_dir, written
from textloom.sources import archives

#: Letters as Japanese signs: consonants as kanji, vowels as kana.
LATIN, SIGNS = "bcdfghjklmnpqrstvwxzaeiouy", "木本東京大阪山川田中水火土金月日人口手足あいうえおや"
KANJI, KANA = SIGNS[:20], SIGNS[20:]
REMOVE = [r"\d+", "the "]


def books_of(spark, sf):
    """Pages in reading order and contents. A book is a host; its pages are named in series, and the contents name some pages by title, some by a file's name."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("book"), F.col("page_id").alias("pos"), "html", F.length("html").alias("n"))
    href = F.when(F.col("n") % 4 == 0, F.format_string("text/s%d_split_%03d.html", F.floor(F.col("page_id") / 40), F.col("page_id"))).otherwise(F.format_string("text/p%d.html", F.col("page_id")))
    p = p.withColumn("href", href)
    title = F.when(F.col("n") % 5 == 0, F.col("href")).when(F.col("n") % 7 == 0, "Contents").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    toc = p.filter("n % 3 > 0").select("book", F.col("pos").alias("ord"), F.concat("href", F.lit("#top")).alias("href"), title.alias("title"))
    return p.select("book", "pos", "href", "html"), toc


def q_chapters(spark, sf):
    c = chapters.chapters_of(*books_of(spark, sf))
    return c.select("book", "ord", "title", "source", F.md5("text").alias("h"), F.length("text").alias("n"), F.md5(F.array_join("headings", "|")).alias("headings"), "n_pages", "by")


def q_notes(spark, sf):
    """Pages as books of one, with a link to a note behind every paragraph and the notes below: the texts are those of the pages as they were."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("book"), F.lit(0).alias("pos"), F.lit("a.html").alias("href"), F.col("html").alias("plain"))
    noted = F.regexp_replace(F.regexp_replace("plain", "</p>", '<a id="r1" href="#n1">12</a></p>'), "</article>", '<div id="n1"><p><a href="#r1">12</a></p></div></article>')
    with_notes = p.select("book", "pos", "href", noted.alias("html"))
    return chapters.pages_of(with_notes).select(F.col("book").alias("page_id"), F.md5("text").alias("h"), F.length("text").alias("n"))


@F.pandas_udf(ArrayType(LongType()))
def _starts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else np.cumsum([0, *(len(w) + 1 for w in t.split(" "))])[:-1])


def _words(df, key):
    """(chapter, i, start, w): words parted by one blank, with their places, which are summed up within the text's row."""
    e = df.select(F.col(key).alias("chapter"), _starts("text").alias("s"), F.split("text", " ").alias("ws"))
    return e.select("chapter", F.posexplode(F.arrays_zip("ws", "s")).alias("i", "x")).select("chapter", "i", F.col("x.ws").alias("w"), F.col("x.s").alias("start"))


def tracked_of(spark, sf, rules):
    """Texts of pages, every third word with a reading, through the cleaning and the removal of rules."""
    texts = written(table(spark, sf, "pages").select(F.col("page_id").alias("chapter"), html.html_text("html").text.alias("text")))
    spans = _words(texts, "chapter").filter("i % 3 = 0 AND length(w) > 1").select("chapter", "start", (F.col("start") + F.length("w")).alias("end"), F.col("w").alias("base"), F.concat(F.upper("w"), F.lit("ん")).alias("reading"))
    return texts, spans, tracking.by_rows(lambda t: T.remove_all(T.clean(t), rules)[0])


def q_tracked(spark, sf):
    found = tracking.clean_spans(*tracked_of(spark, sf, REMOVE))
    return found.groupBy("chapter", "how").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "base", "reading"))), lambda x: F.concat_ws(":", x.start.cast("string"), x.end.cast("string"), x.base, x.reading)), ",")).alias("h"))


def q_difference(spark, sf):
    """Documents in Japanese signs against themselves with some words read out: the spans of the words come back."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chapter"), F.translate(F.lower("text"), LATIN, SIGNS).alias("text"))
    read = F.regexp_replace("text", f"([{KANJI}])([{KANA}])([{KANJI}])(?=[.,])", "よみ$2かた")
    return tracking.diff_spans(d.select("chapter", F.col("text").alias("plain"), read.alias("ruby"))).select("chapter", "start", "end", "base", "reading")


def q_small_capitals(spark, sf):
    """Documents whose paragraphs begin with four words in capitals."""
    head = F.regexp_extract("text", r"^((?:\S+ ){0,4})", 1)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.upper(F.replace(head, F.lit("ß"), F.lit("ss"))), F.expr("substring(text, length(regexp_extract(text, '^((?:\\\\S+ ){0,4})', 1)) + 1)")).alias("text"))
    return casing.small_capitals(d).select(F.col("doc").alias("doc_id"), F.md5("text").alias("h"))


RULES = sanitise.Rules(drop=["^[A-Z][a-z]*ung "], cutoff=["Licensed under", r"^All rights reserved"], remove=[r"[$%&*#]{3}", r"\d{4,}"])


def q_sanitised(spark, sf):
    """Documents as chapters, with small capitals at their heads, lines of signs, and every seventh word with a reading."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chapter"), F.substring_index("text", " ", 4).alias("title"), F.concat(F.upper(F.substring_index("text", " ", 3)), F.lit(" "), F.replace("text", F.lit("\n"), F.lit("\n\n***\n\n"))).alias("text"), F.array(F.substring_index("text", "\n", 1)).alias("headings"))
    words = _words(d, "chapter").filter("i % 7 = 0 AND length(w) > 2 AND NOT w LIKE concat('%', chr(10), '%')")
    spans = words.select("chapter", "start", (F.col("start") + F.length("w")).alias("end"), F.col("w").alias("base"), F.concat(F.lit("よ"), F.lower("w")).alias("reading"))
    texts, found = sanitise.sanitise(d, spans, RULES)
    n = found.groupBy("chapter").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("start").alias("starts"), F.max("how").alias("how"))
    return texts.join(n, "chapter", "left").select(F.col("chapter").alias("doc_id"), "reason", "why", F.md5("text").alias("h"), "raw_chars", "clean_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "starts", "how")


def q_growth(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chapter"), F.translate(F.lower("text"), LATIN, SIGNS).alias("text"))
    s = d.select("chapter", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(50))).alias("start")).select("chapter", F.col("start").cast("long").alias("start")).select("chapter", "start", (F.col("start") + 1 + F.col("start") % 3).alias("end"), F.col("start").alias("id"))
    return S.grown(d, s, KANJI, KANA).select("chapter", "id", "surface_end", "run_start", "run_end")


def layers_of(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    w = c.select(F.col("conv_id").alias("chapter"), "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    at = (F.col("i") * 23 + F.col("turn") * 57) % 3000
    s = w.select("chapter", ((F.col("i") + F.col("turn")) % 3).cast("int").alias("layer"), at.cast("long").alias("start"), (at + F.length("w")).cast("long").alias("end")).distinct()
    s = s.withColumn("id", F.row_number().over(Window.partitionBy("chapter").orderBy("layer", "start", "end")))
    return c.groupBy(F.col("conv_id").alias("chapter")).agg(F.lit(2500).cast("long").alias("size")), s


def q_layers(spark, sf):
    _, s = layers_of(spark, sf)
    return S.layered(s).select("chapter", "layer", "start", "end", "id")


def q_segments(spark, sf):
    return S.segments(*layers_of(spark, sf))


def chunks_and_headings(spark, sf):
    """Lines of documents are chunks, some of two lines; gaps are of many kinds. Every third line by length is a heading."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chapter"), F.posexplode(F.split("text", "\n")).alias("chunk", "line"))
    k = (F.col("chunk") + F.length("line")) % 8
    text = F.when(F.col("chunk") % 2 == 0, F.concat(F.col("line"), F.lit("\n  \n"), F.upper(F.replace("line", F.lit("ß"), F.lit("-"))))).otherwise(F.concat(F.col("line"), F.when(F.length("line") % 4 == 1, ",").otherwise("")))
    gaps = ["", " ", "\n", "\n\n", "\n\n\n", "\n***\n", "\n\n\n\n\n", f" {T.SECTION} "]
    gap = F.element_at(F.array(*map(F.lit, gaps)), (k + 1).cast("int"))
    w = Window.partitionBy("chapter").orderBy("chunk")
    c = d.select("chapter", "chunk", text.alias("text"), F.when(F.lead("chunk").over(w).isNotNull(), gap).alias("gap"))
    h = d.filter(F.length("line") % 3 == 0).select("chapter", F.concat(F.lit(" "), "line").alias("heading"), F.when(F.length("line") % 2 == 0, " Title").alias("category"))
    return c, h


def q_heading_pauses(spark, sf):
    return chapters.heading_pauses(*chunks_and_headings(spark, sf))


def q_chunk_pauses(spark, sf):
    return chapters.chunk_pauses(*chunks_and_headings(spark, sf))


def q_published(spark, sf):
    """Turns of conversations published as chunks; then published again for all of them, shortened where a turn is the last of an even number."""
    at = shared_dir(spark)
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 7).alias("book"), F.col("conv_id").alias("chapter"), F.col("turn").alias("chunk"), "text")
    sinks.write_chunks(c, at)
    sinks.write_chunks(c.filter("chunk < 6 OR chapter % 2 = 0"), at)
    m = sinks.manifest(spark, at).groupBy("book").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n").alias("chunks"))
    data = spark.read.parquet(f"{at}/data").groupBy("book").agg(F.sum(F.length("text")).alias("chars"), F.max("chunk").alias("last"))
    return m.join(data, "book").select(F.col("book").cast("long").alias("book"), "chapters", "chunks", "chars", "last")


def q_archives(spark, sf):
    """Pages packed into archives and read again."""
    archives.register(spark)
    at = shared_dir(spark)
    p = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit("/index.html")).alias("name"), F.encode("html", "utf-8").alias("content"))
    p.write.format("archives").mode("append").save(at)
    got = spark.read.format("archives").load(at)
    return got.select(F.regexp_extract("name", r"^(\d+)/", 1).cast("long").alias("page_id"), F.md5("content").alias("h"), F.octet_length("content").alias("bytes"))


def q_contents_tree(spark, sf):
    """Each page as a section with its links as entries, of a book that the page is the contents of; the third link holds those behind it."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1))
    leaf = lambda l, inner=None: F.struct(l.alias("title"), l.alias("href"), (inner if inner is not None else F.array().cast("array<struct<title: string, href: string>>")).alias("children"))  # noqa: E731, E741
    p = table(spark, sf, "pages").select("page_id", "url", links.alias("l"))
    flat = lambda a: F.transform(a, lambda l: F.struct(l.alias("title"), l.alias("href")))  # noqa: E731, E741
    kids = F.concat(F.transform(F.slice("l", 1, 2), lambda l: leaf(l)), F.when(F.size("l") > 2, F.array(leaf(F.get("l", F.lit(2)), flat(F.slice("l", F.lit(4), F.size("l")))))).otherwise(F.array().cast("array<struct<title: string, href: string, children: array<struct<title: string, href: string>>>>")))  # noqa: E741
    tree = F.to_json(F.array(F.struct(F.lit("").alias("title"), F.col("url").alias("href"), kids.alias("children"))))
    return archives.flatten_contents(p.select("page_id", tree.alias("tree")), ["page_id"], "tree")


QUERIES = {
    "s1_archives": q_archives, "s2_contents": q_contents_tree,
    "f8_small_capitals": q_small_capitals, "f11_sanitised": q_sanitised, "f15_chapters": q_chapters, "f43_tracked_spans": q_tracked, "f44_difference": q_difference, "j13_notes": q_notes, "j15_heading_pauses": q_heading_pauses, "j22_layers": q_layers, "j22_segments": q_segments, "p17_p19_pauses": q_chunk_pauses,
    "s16_published": q_published, "w21_growth": q_growth,
}

_LAYERS = """
word AS (SELECT conv_id AS chapter, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
span0 AS (SELECT DISTINCT chapter, CAST((i + turn) % 3 AS INT) AS layer, CAST((i * 23 + turn * 57) % 3000 AS BIGINT) AS start, CAST((i * 23 + turn * 57) % 3000 + length(w) AS BIGINT) AS "end" FROM word),
span AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter ORDER BY layer, start, "end") AS INT) AS id FROM span0)
"""
_CHUNKS = """
line AS (SELECT doc_id AS chapter, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS chunk, unnest(string_split(text, chr(10))) AS line FROM documents),
chunk AS (
  SELECT chapter, chunk, CASE WHEN chunk % 2 = 0 THEN line || chr(10) || '  ' || chr(10) || upper(replace(line, 'ß', '-')) ELSE line || CASE WHEN length(line) % 4 = 1 THEN ',' ELSE '' END END AS text,
         CASE WHEN lead(chunk) OVER (PARTITION BY chapter ORDER BY chunk) IS NOT NULL THEN
           ['', ' ', chr(10), repeat(chr(10), 2), repeat(chr(10), 3), chr(10) || '***' || chr(10), repeat(chr(10), 5), ' ' || chr(57344) || ' '][1 + (chunk + length(line)) % 8] END AS gap FROM line),
head AS (
  SELECT chapter, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS key, max(CASE WHEN length(line) % 2 = 0 THEN 5 ELSE 3 END) AS pause FROM line WHERE length(line) % 3 = 0 AND trim(line) <> '' GROUP BY ALL),
part AS (SELECT chapter, chunk, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS key FROM (SELECT chapter, chunk, unnest(string_split(text, chr(10))) AS x FROM chunk) WHERE trim(x) <> ''),
headed AS (SELECT chapter, chunk, max(pause) AS pause FROM part LEFT JOIN head USING (chapter, key) GROUP BY ALL HAVING count(*) = count(pause))
"""

ORACLES = {
    "s1_archives": "SELECT page_id, md5(html) AS h, strlen(html) AS bytes FROM pages",
    "s2_contents": """WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS l FROM pages)
SELECT page_id, 0 AS ord, 0 AS depth, '' AS title, url AS href FROM l UNION ALL SELECT page_id, i AS ord, CASE WHEN i > 3 THEN 2 ELSE 1 END AS depth, l[i] AS title, l[i] AS href FROM (SELECT page_id, l, CAST(unnest(range(1, len(l) + 1)) AS INT) AS i FROM l)""",
    "j22_layers": f"""WITH {_LAYERS},
one AS (SELECT * FROM span s WHERE layer = 0 OR NOT EXISTS (SELECT 1 FROM span o WHERE o.chapter = s.chapter AND o.layer = 0 AND o.start < s."end" AND s.start < o."end"))
SELECT chapter, layer, start, "end", id FROM one s WHERE layer < 2 OR NOT EXISTS (SELECT 1 FROM one o WHERE o.chapter = s.chapter AND o.layer = 1 AND o.start < s."end" AND s.start < o."end")""",
    "j22_segments": f"""WITH {_LAYERS},
fit AS (SELECT chapter, layer, greatest(start, 0) AS s, least("end", 2500) AS e FROM span WHERE greatest(start, 0) < least("end", 2500)),
cut AS (SELECT chapter, s AS p FROM fit UNION SELECT chapter, e FROM fit UNION SELECT DISTINCT conv_id, unnest([0, 2500]) FROM conversations),
seg AS (SELECT chapter, p AS start, lead(p) OVER (PARTITION BY chapter ORDER BY p) AS "end" FROM cut)
SELECT g.chapter, g.start, g."end", CAST(coalesce(min(f.layer), -1) AS INT) AS layer FROM seg g LEFT JOIN fit f ON f.chapter = g.chapter AND f.s <= g.start AND f.e >= g."end" WHERE g."end" IS NOT NULL GROUP BY ALL""",
    "j15_heading_pauses": f"WITH {_CHUNKS} SELECT chapter, chunk, CAST(pause AS INT) AS pause FROM headed",
    "p17_p19_pauses": f"""WITH {_CHUNKS},
c AS (SELECT c.*, h.pause AS own, lead(h.pause) OVER w AS nxt, lag(c.gap) OVER w AS before, lag(c.chunk) OVER w IS NULL AS first FROM chunk c LEFT JOIN headed h USING (chapter, chunk) WINDOW w AS (PARTITION BY c.chapter ORDER BY c.chunk)),
k AS (SELECT *, contains(gap, chr(10)) OR contains(gap, chr(57344)) AS broken, contains(before, chr(10)) OR contains(before, chr(57344)) AS broken0,
        CASE WHEN contains(gap, chr(57344)) OR contains(gap, repeat(chr(10), 3)) AND NOT contains(gap, repeat(chr(10), 5)) THEN 3 WHEN contains(gap, repeat(chr(10), 5)) THEN 5 ELSE 1 END AS blank,
        regexp_matches(text, '[、，,;；:：—―─━…⋯][」』）】］〉》”’"'']*$') AND contains(gap, chr(10)) AND NOT contains(gap, chr(57344)) AND NOT contains(gap, '*') AS goes FROM c)
SELECT chapter, chunk, CAST(CASE WHEN gap IS NULL OR goes THEN 1 WHEN broken THEN greatest(blank, CASE WHEN contains(gap, '*') OR contains(gap, chr(57344)) THEN 3 ELSE 1 END, CASE WHEN own IS NOT NULL OR nxt IS NOT NULL THEN greatest(3, coalesce(own, 1), coalesce(nxt, 1)) ELSE 1 END) ELSE blank END AS INT) AS pause,
       gap IS NOT NULL AND (broken OR gap = ' ' AND NOT regexp_matches(text, '[。！？!?…][」』）】］〉》”’"'']*$')) AS hard,
       (first OR coalesce(broken0, false)) AND (gap IS NULL OR broken) AS standalone FROM k""",
    "f8_small_capitals": r"""WITH head AS (SELECT doc_id, text, regexp_extract(text, '^((?:\S+ ){0,4})', 1) AS h FROM documents),
doc AS (SELECT doc_id, upper(replace(h, 'ß', 'ss')) || substr(text, length(h) + 1) AS text FROM head),
word AS (SELECT doc_id, text, regexp_extract_all(text, '\p{L}(?:[\p{L}''’\-]|\p{M})*') AS ws FROM doc),
run AS (SELECT *, list_filter(ws[1:7], lambda w: regexp_matches(w, '\p{L}') AND NOT regexp_matches(w, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]')) AS caps,
          coalesce(list_position(list_transform(ws[1:7], lambda w: NOT (regexp_matches(w, '\p{L}') AND NOT regexp_matches(w, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]'))), true), 0) - 1 AS n FROM word),
fit AS (SELECT doc_id, text, ws, n, regexp_matches(text, '[a-z]') AND n BETWEEN 2 AND 6 AND coalesce(regexp_matches(ws[n + 1], '\p{Ll}'), false) AS fits FROM run),
cnt AS (SELECT doc_id, lower(w) AS key, w, count(*) AS c, min(p) AS f FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM fit WHERE fits) WHERE regexp_matches(w, '\p{Ll}') GROUP BY ALL),
map AS (SELECT doc_id, key, w AS known FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY c DESC, CASE WHEN regexp_matches(w, '^\p{Lu}.*\p{Ll}') THEN 3 WHEN NOT regexp_matches(w, '\p{Lu}') THEN 2 ELSE 1 END DESC, f) AS rn FROM cnt) WHERE rn = 1),
first AS (SELECT doc_id, p, ws[p] AS w, lower(ws[p]) AS low FROM (SELECT doc_id, ws, unnest(range(1, n + 1)) AS p FROM fit WHERE fits)),
low AS (SELECT f.*, known, list_contains(['STOPS'], f.low) AS stop FROM first f LEFT JOIN map m ON m.doc_id = f.doc_id AND m.key = f.low),
new AS (SELECT doc_id, p, w, bool_or(known IS NOT NULL OR stop) OVER (PARTITION BY doc_id) AS sign,
    CASE WHEN known IS NOT NULL THEN CASE WHEN p = 1 AND NOT regexp_matches(known, '\p{Lu}') THEN upper(known[1]) || known[2:] ELSE known END
      WHEN stop THEN CASE WHEN p = 1 THEN upper(low[1]) || low[2:] ELSE low END
      WHEN list_contains(['SHORTS'], low) OR regexp_full_match(w, '[IVXLCDM]+') OR length(w) <= 3 OR length(w) <= 4 AND NOT regexp_matches(low, '[aeiouyāīūṛṝḷḹ]') THEN w
      WHEN p = 1 THEN array_to_string(list_transform(regexp_extract_all(w, '[^\-''’]*[\-''’]?'), lambda x: upper(x[1]) || lower(x[2:])), '') ELSE low END AS r FROM low),
gaps AS (SELECT doc_id, regexp_split_to_array(text, '\p{L}(?:[\p{L}''’\-]|\p{M})*') AS g FROM fit WHERE fits),
made AS (SELECT n.doc_id, string_agg(g[p] || r, '' ORDER BY p) AS lead, max(p) AS k FROM new n JOIN gaps USING (doc_id) WHERE sign GROUP BY n.doc_id)
SELECT f.doc_id, md5(CASE WHEN m.lead IS NULL THEN f.text ELSE m.lead || substr(f.text, length(m.lead) + 1) END) AS h FROM fit f LEFT JOIN made m USING (doc_id)""".replace("STOPS", "', '".join(casing.STOP_WORDS)).replace("SHORTS", "', '".join(casing.ABBREVIATIONS)),
    "w21_growth": f"""WITH d AS (SELECT doc_id AS chapter, translate(lower(text), '{LATIN}', '{SIGNS}') AS t FROM documents),
s AS (SELECT *, start + 1 + start % 3 AS e FROM (SELECT chapter, t, unnest(range(0, length(t) + 1, 50)) AS start FROM d)),
g AS (SELECT chapter, start, e, length(regexp_extract(substr(t, e + 1), '^[{KANA}]*')) AS tail, regexp_full_match(substr(t, start + 1, e - start), '[{KANJI}]+') AS inside,
        start - length(regexp_extract(substr(t, 1, start), '[{KANJI}]*$')) AS l, e + length(regexp_extract(substr(t, e + 1), '^[{KANJI}]*')) AS r FROM s WHERE e <= length(t))
SELECT chapter, start AS id, e + tail AS surface_end, CASE WHEN inside AND r - l > 1 THEN l END AS run_start, CASE WHEN inside AND r - l > 1 THEN r END AS run_end FROM g""",
    "s16_published": """SELECT conv_id % 7 AS book, count(DISTINCT conv_id) AS chapters, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last FROM conversations WHERE turn < 6 OR conv_id % 2 = 0 GROUP BY 1""",
}
