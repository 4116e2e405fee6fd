"""Source divergence audit: how far the word frequencies of each source stand from those of its language and of its other sources.

Plain relational. Terms are exploded and counted by (lang, source, term); a language keeps the terms of enough of its documents;
its sources are joined with the kept terms, so that absent ones count as zeros; sources meet pairwise on (lang, term), and sums
are ranked. All arithmetic is in integers or decimals, so it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialise

#: What parts terms: ASCII signs that are no letters. Terms are the runs of all others; parting is far cheaper than collecting matches.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
SALTS = 64
#: (lang, source) groups sent to all tasks, if they are no more (counted) and their names take no more bytes.
BROADCAST_GROUPS, BROADCAST_BYTES = 1 << 16, 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the number of rows that hold it. Sums are made before the shuffle."""
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    found = F.sort_array(F.split(F.translate("text", _UPPER, _LOWER), GAP))
    # in a sorted list the first of equal terms stands for the document
    flagged = F.transform("w", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get("w", i - 1) != t)).cast("int").alias("new")))
    words = slim.select("lang", "source", found.alias("w")).select("lang", "source", F.explode(flagged).alias("t")).select("lang", "source", "t.*")
    words = words.filter("term <> ''")  # a text that begins or ends with a gap
    return words.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("docs"))


def _share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 size)); decimals of 38 digits hold the product."""
    exact = F.lit(SCALE) * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", exact, (total + 2 * size).cast("decimal(20,0)")).cast("long")


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): both are at most SCALE + 1, so the square fits into 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    Part 'pair' has a row for every other source of the language, part 'term' the `top` kept terms that are most typical of the
    source beside its language. Nulls of lang, source and text are read as '', which is a group like any other; each row is a
    document of its own, repeated rows too. A text without terms, or of any length, is read whole; its group takes part even if it
    has no terms. Equal values rank by item in the order of UTF-8 bytes. An empty table gives an empty result; other columns
    are not read, whatever their names. Pairs of sources and their sums over all kept terms are the result asked for, so the work is in
    proportion to the pairs of sources of a language times its kept terms; counts of a (lang, term) are spread by both.
    """
    counts = materialise(term_counts(docs, text=text, lang=lang, source=source), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = materialise(kept.select("lang", "term", "lang_n"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("size"))
    own = materialise(counts.drop("docs").join(kept, ["lang", "term"]), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "size"))), "groups")
    n_groups, n_bytes = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source") + 24), F.lit(0))).first()
    small = n_groups <= BROADCAST_GROUPS and n_bytes <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)

    # every source of a language with every kept term; a language's terms are dealt over SALTS tasks where the groups can't be sent
    dense = groups.select("lang", "source", "total", "size")
    if small:
        dense = kept.select("lang", "term").join(F.broadcast(dense), "lang")
    else:
        dealt = kept.select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt"))
        dense = dealt.join(dense.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"]).drop("salt")
    dense = dense.join(own.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    dense = materialise(dense.select("lang", "term", "source", _share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("size")).alias("p")), "dense")

    x, y = (dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias("p" + s)) for s in "ab")
    sums = x.join(y, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(_distance(F.col("pa"), F.col("pb"))).alias("value"))
    sums = materialise(sums, "sums")
    # the distance is symmetric; sources of a language without kept terms are at 0 from each other
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    bare = groups.filter("size = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = both.unionByName(bare).withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    typical = own.join(hint(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total"), F.col("size")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("size")).alias("q"))
    typical = typical.filter("p > q").select("lang", "source", "item", _distance(F.col("p"), F.col("q")).alias("value"))
    terms = typical.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
