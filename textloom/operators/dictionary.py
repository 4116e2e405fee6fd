"""Reading dictionaries: votes, conflicts, priority merges. All tie orders are explicit (first seen wins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import path_safe


def reading_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """count and first-seen order of each reading of a base (pairs: *by, base, reading, seen)."""
    return pairs.groupBy(*by, "base", "reading").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first_seen"))


def majority(counts: DataFrame, by: list[str], aligned: Column | None = None) -> DataFrame:
    """The preferred reading of a base: most counts, ties to the first seen; with `aligned`, dictionary readings come first.

    Ranks: aligned with the most counts, then any aligned, then the majority.
    """
    keys = [*by, "base"]
    most = counts.groupBy(*keys).agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("readings"))
    both = counts.join(most, keys)
    rank = F.lit(2) if aligned is None else F.when(aligned & (F.col("n") == F.col("most")), 0).when(aligned, 1).otherwise(2)
    best = F.min_by(F.struct("reading", "n"), F.struct(rank, -F.col("n"), F.col("first_seen")))
    return both.groupBy(*keys, "total", "readings").agg(best.alias("b")).select(*keys, F.col("b.reading").alias("reading"), F.col("b.n").alias("n"), "total", "readings")


def distinct_readings(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Bases of more than one character: with one reading a replacement, with more a conflict; blank ones don't count."""
    base, reading = F.trim("base"), F.trim("reading")
    own = pairs.select(*by, base.alias("base"), reading.alias("reading")).filter((F.length("base") > 1) & (F.length("reading") > 0))
    out = own.groupBy(*by, "base").agg(F.sort_array(F.collect_set("reading")).alias("rs"))
    return out.select(*by, "base", F.when(F.size("rs") == 1, "replacement").otherwise("conflict").alias("kind"), F.array_join("rs", ",").alias("readings"))


def escape_pattern(text: Column) -> Column:
    """Regular-expression characters of a literal, escaped."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def context_pattern(base: Column, surface: Column) -> Column:
    """A look-around pattern for a base within its surface; empty unless the base occurs once and the surface has more."""
    at = F.instr(surface, base)
    once = (at > 0) & (F.length(F.replace(surface, base, F.lit(""))) + F.length(base) == F.length(surface))
    prefix, suffix = F.substring(surface, F.lit(1), at - 1), F.substring(surface, at + F.length(base), F.length(surface))
    head = F.when(F.length(prefix) > 0, F.concat(F.lit("(?<="), escape_pattern(prefix), F.lit(")"))).otherwise("")
    tail = F.when(F.length(suffix) > 0, F.concat(F.lit("(?="), escape_pattern(suffix), F.lit(")"))).otherwise("")
    return F.when(once & ((F.length(prefix) > 0) | (F.length(suffix) > 0)), F.concat(head, escape_pattern(base), tail)).otherwise("")


def global_entries(pairs: DataFrame) -> DataFrame:
    """Entries to spread over a book (pairs: base, surface, reading, seen).

    A base with one reading is a literal entry. Of a conflict, the selected reading must be a strict majority; it is then
    spread to the surfaces in which it is a strict majority too, by look-around patterns.
    """
    own = pairs.filter(F.length("base") > 1)
    chosen = majority(reading_counts(own, []), [])
    literal = chosen.filter("readings = 1").select("base", F.lit("").alias("pattern"), F.lit("").alias("context"), "reading", "n", "total")
    strong = chosen.filter("readings > 1 AND 2 * n > total").select("base", F.col("reading").alias("selected"))
    seen = own.groupBy("base", "reading").agg(F.min("seen").alias("first_seen"))
    local = own.groupBy("base", "surface", "reading").agg(F.count(F.lit(1)).alias("n")).join(seen, ["base", "reading"])
    local = local.groupBy("base", "surface").agg(F.sum("n").alias("total"), F.min_by(F.struct("reading", "n"), F.struct(-F.col("n"), F.col("first_seen"))).alias("b"))
    local = local.filter("2 * b.n > total").join(strong, "base").filter("b.reading = selected")
    local = local.withColumn("pattern", context_pattern(F.col("base"), F.col("surface"))).filter("pattern <> ''")
    return literal.unionByName(local.select("base", "pattern", F.col("surface").alias("context"), F.col("b.reading").alias("reading"), F.col("b.n").alias("n"), "total"))


def conflicts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Bases of several readings, the readings by count and then first seen."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_seen", "reading")))
    out = counts.groupBy(*by, "base").agg(rows.alias("r")).filter(F.size("r") > 1)
    return out.select(*by, "base", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x.reading, (-x.n).cast("string"))), ",").alias("readings"))


def promotions(counts: DataFrame, known: DataFrame, least: int = 5, share: float = 0.9) -> DataFrame:
    """Conflicts whose majority is so clear that it becomes a global entry; bases already known (base) don't."""
    chosen = majority(counts, []).filter((F.length("base") > 1) & (F.col("readings") > 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total")))
    return chosen.join(known, "base", "left_anti").select("base", "reading", "n", "total")


def compounds(pairs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Per group, bases whose majority reading was seen at least `least` times and is a strict majority."""
    return majority(reading_counts(pairs, by), by).filter((F.col("n") >= least) & (2 * F.col("n") > F.col("total"))).select(*by, "base", "reading", "n")


def merge_overrides(layers: DataFrame) -> DataFrame:
    """Entries (scope priority, ord, base, pattern, reading, mode) merged: per key the last writer of the highest priority wins, at the place where the key came first."""
    key = F.when(F.col("pattern").isNotNull(), F.concat(F.lit("re:"), F.col("pattern"))).otherwise(F.concat(F.lit("lit:"), F.col("base")))
    own = layers.withColumn("key", key)
    return own.groupBy("key").agg(F.max_by(F.struct("base", "pattern", "reading", "mode"), F.struct("priority", "ord")).alias("e"), F.min(F.struct("priority", "ord")).alias("at")).select("key", "e.base", "e.pattern", "e.reading", "e.mode", F.col("at.priority").alias("at_priority"), F.col("at.ord").alias("at_ord"))


def application_order(entries: DataFrame, by: list[str]) -> DataFrame:
    """Rank of literal entries: longest base first, ties in list order; patterns follow in list order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.col("pattern").isNotNull().cast("int"), F.when(F.col("pattern").isNull(), -F.length("base")).otherwise(0), "ord")
    return entries.withColumn("rank", F.row_number().over(w))


def ordered_union(lists: DataFrame, by: list[str], value: str) -> DataFrame:
    """Values of lists (layer, ord) without those whose key, blanks collapsed and lower-cased, came before."""
    key = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    own = lists.withColumn("key", key).filter("key <> ''")
    return own.groupBy(*by, "key").agg(F.min(F.struct("layer", "ord", F.col(value).alias("v"))).alias("m")).select(*by, "key", F.col("m.v").alias(value), F.col("m.layer").alias("layer"), F.col("m.ord").alias("ord"))


def category_map(headings: DataFrame, by: list[str]) -> DataFrame:
    """One category per heading key: title beats section."""
    rank = F.when(F.col("category") == "title", 2).when(F.col("category") == "section", 1).otherwise(0)
    return headings.groupBy(*by, "key").agg(F.max(rank).alias("r")).select(*by, "key", F.when(F.col("r") == 2, "title").when(F.col("r") == 1, "section").otherwise("").alias("category"))


def unique_folders(books: DataFrame) -> DataFrame:
    """(book, folder) of books (book, title): path-safe titles, `book` for empty ones; the second of equal ones, by book, ends in -2 and so on."""
    own = books.select("book", F.coalesce(F.nullif(path_safe(F.col("title")), F.lit("")), F.lit("book")).alias("folder"))
    w = Window.partitionBy("folder").orderBy("book")
    numbered = own.withColumn("n", F.row_number().over(w))
    return numbered.select("book", F.when(F.col("n") == 1, F.col("folder")).otherwise(F.concat("folder", F.lit("-"), F.col("n").cast("string"))).alias("folder"))
