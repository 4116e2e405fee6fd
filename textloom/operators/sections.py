"""Lines of signs that a document parts its sections with, learned from the document and put as section marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.shared import written

DENSITY, ALONE = 0.35, 0.8


def markers(texts: DataFrame) -> DataFrame:
    """(doc, marker) of texts (doc, text): lines without letters and numbers that mark sections.

    A marker stands twice or more, mostly with blank lines around its runs, and its signs are rare in other lines; a lone one is a single sign that no other
    line holds. Lines with brackets or quotation marks are none.
    """
    w = Window.partitionBy("doc").orderBy("p")
    stripped = F.transform(F.split("text", "\n"), T.strip)
    texts = texts.select("doc", "text").filter(F.exists(stripped, T.is_symbolic))  # others have none
    lines = texts.select("doc", F.posexplode(stripped).alias("p", "x"))
    own = lines.withColumn("candidate", T.is_symbolic(F.col("x")))
    # runs of equal candidates; a run is alone if the lines before and behind it are blank or missing
    goes = F.col("candidate") & F.coalesce(F.lag("x").over(w) == F.col("x"), F.lit(False))
    run = own.withColumn("before", F.coalesce(F.lag("x").over(w), F.lit(""))).withColumn("after", F.coalesce(F.lead("x").over(w), F.lit(""))).withColumn("run", F.sum((~goes).cast("int")).over(w))
    per_run = run.filter("candidate").groupBy("doc", "run", "x").agg(F.count(F.lit(1)).alias("n"), F.min_by("before", "p").alias("before"), F.max_by("after", "p").alias("after"))
    stats = per_run.groupBy("doc", "x").agg(F.sum("n").alias("n"), F.sum(F.when((F.col("before") == "") & (F.col("after") == ""), F.col("n")).otherwise(0)).alias("alone"))
    signs = stats.select("doc", "x", F.explode(F.split(F.regexp_replace("x", r"\s", ""), "")).alias("c")).filter("c <> ''")
    # the signs of a document are counted within its other lines, one row a document
    kinds = signs.groupBy("doc").agg(F.collect_set("c").alias("cs"))
    others = F.array_join(F.filter(stripped, lambda x: ~T.is_symbolic(x)), "\n")
    times = lambda t: F.transform("cs", lambda c: F.struct(c.alias("c"), (F.length(t) - F.length(F.replace(t, c, F.lit("")))).alias("k")))
    there = texts.join(kinds, "doc").select("doc", F.inline(T.let(others, times)))
    embedded = signs.join(there, ["doc", "c"], "left").groupBy("doc", "x").agg(F.sum(F.coalesce("k", F.lit(0))).alias("embedded"), F.count(F.lit(1)).alias("size"))
    both = stats.join(embedded, ["doc", "x"])
    often = (F.col("n") >= 2) & (F.col("alone") >= ALONE * F.col("n"))
    once = (F.col("n") == 1) & (F.col("size") == 1) & (F.col("embedded") == 0)
    return both.filter(~T.has_bracket(F.col("x")) & (F.col("embedded") <= DENSITY * F.col("n") * F.col("size")) & (often | once)).select("doc", F.col("x").alias("marker"))


def markers_of(text: Column) -> Column:
    """The markers of one text, as `markers` finds them, within its row; an array, null of a null text. Of the lines only those without letters and numbers are taken apart."""
    none = F.array().cast("array<string>")
    times = lambda t, part: F.length(t) - F.length(F.replace(t, part, F.lit("")))
    # blocks of such lines, blank ones among them; a text begins and ends with a blank line
    blocks = F.regexp_extract_all(F.concat(F.lit("\n\n"), text, F.lit("\n\n")), F.lit(rf"((?:\n[^\p{{L}}\p{{N}}\p{{M}}\n{T.SECTION}]*+(?=\n))++)"), F.lit(1))
    stripped = lambda b: F.transform(F.split(F.substring(b, F.lit(2), F.length(b)), "\n"), T.strip)

    def fits(x: Column, own: Column, lines: Column) -> Column:
        bare = F.regexp_replace(x, r"\s", "")
        signs, size = F.array_distinct(F.split(bare, "")), F.length(bare)
        runs = F.concat(F.lit(r"(?<=\n\n)(?:\Q"), x, F.lit(r"\E\n)++(?=\n)"))
        n = F.size(F.filter(lines, lambda y: y == x))
        alone = (F.length(own) - F.length(F.regexp_replace(own, runs, F.lit("")))) / (F.length(x) + 1)
        embedded = F.aggregate(signs, F.lit(0), lambda k, c: k + times(bare, c) * (times(text, c) - times(own, c)))
        fit = lambda v: (v.k <= DENSITY * v.n * size) & ((v.n >= 2) & (alone >= ALONE * v.n) | (v.n == 1) & (size == 1) & (v.k == 0))
        return ~T.has_bracket(x) & T.let(F.struct(n.alias("n"), embedded.alias("k")), fit)

    def of(lines: Column) -> Column:
        own = F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
        return T.let(own, lambda t: F.filter(F.array_distinct(F.filter(lines, lambda x: ~x.isin("", "x"))), lambda x: fits(x, t, lines)))

    # an x stands for the lines behind a block
    seen = lambda bs: F.flatten(F.transform(bs, lambda b: F.concat(stripped(b), F.array(F.lit("x")))))
    return T.let(F.filter(blocks, lambda b: b.rlike(r"\S")), lambda bs: F.when(F.size(bs) == 0, none).when(bs.isNotNull(), T.let(seen(bs), of)))


def sectioned(text: Column) -> Column:
    """As with_sections, for one text within its row."""
    mark = lambda x, m: F.when(~x.rlike(r"[\p{L}\p{N}\p{M}]") & F.array_contains(m, T.strip(x)), T.SECTION).otherwise(x)
    marked = lambda t, m: F.array_join(F.transform(F.split(t, "\n"), lambda x: mark(x, m)), "\n")
    return T.let(text, lambda t: T.let(T.let(markers_of(t), lambda m: F.when(F.size(m) > 0, marked(t, m)).otherwise(t)), tidy))


def tidy(text: Column) -> Column:
    """Section marks in paragraphs of their own, one where several stand together, none at either end. A text without any stays as it is."""
    s = T.SECTION
    t = T.where_any(text, [f" {s}", f"\t{s}", f"{s} ", f"{s}\t"], lambda x: F.regexp_replace(x, f"[ \t]*{s}[ \t]*", s))
    t = F.regexp_replace(F.replace(t, F.lit(s), F.lit(f"\n\n{s}\n\n")), "\n{3,}", "\n\n")
    t = T.where_any(t, [f"{s}\n\n{s}"], lambda x: F.regexp_replace(F.regexp_replace(x, f"(?:\n\n{s}){{2,}}", f"\n\n{s}"), f"(?:{s}\n\n){{2,}}", f"{s}\n\n"))
    t = F.regexp_replace(t, rf"^(?:\s*{s}\s*)+", "")
    t = T.let(t, lambda x: F.when(F.substring(x, -1, 1).rlike(rf"[\s{s}\x{{85}}\x{{2028}}\x{{2029}}]"), F.regexp_replace(x, rf"(?:\s*{s}\s*)+$", "")).otherwise(x))
    return F.when(F.contains(text, F.lit(s)), t).otherwise(text)


def with_sections(texts: DataFrame) -> DataFrame:
    """(doc, text) with the document's markers as section marks. A null text stays null; doc must be unique."""
    sets = markers(texts).groupBy("doc").agg(F.collect_set("marker").alias("m"))
    both = texts.select("doc", "text").join(sets, "doc", "left")
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.array_contains("m", T.strip(x)), T.SECTION).otherwise(x)), "\n")
    return both.select("doc", tidy(F.when(F.col("m").isNotNull(), marked).otherwise(F.col("text"))).alias("text"))


def normalise(texts: DataFrame) -> DataFrame:
    """(doc, text) cleaned, with sections found by markers as well as by blank lines. The cleaned texts are written, as several steps read them."""
    return with_sections(written(texts.select("doc", T.clean(F.col("text")).alias("text"))))
