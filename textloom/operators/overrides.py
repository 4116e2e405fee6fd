"""Reading overrides applied to texts, their lines, and the surfaces that readings are counted in."""

from __future__ import annotations

import contextlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as T
from textloom.operators.dictionary import escape_pattern

# What may stand beside a kanji that is a word of its own, and the modes' names.
PARTICLES = "はへをにでとがのもやかねよぞぜさなわ" "ハヘヲニデトガノモヤカネヨゾゼサナワ"
COPULAS = "だでダデ"
SAFE_MARKS = "々〆ヶヵゝゞ"
MODES = {"first": ("first", "once", "single", "one"), "isolated": ("isolated", "isolate", "boundary", "standalone"), "kanji": ("kanji", "kanji-boundary", "kanji_boundary", "kanjiboundary")}

_OPEN = rf"[^\s\p{{P}}{PARTICLES}]"  # a character that doesn't part words
_BLOCKS = f"[{T.JAPANESE}&&{_OPEN}]"
#: Entries of so many bytes are sent to all tasks; larger dictionaries are repeated for so many parts of a group's texts.
SENT_BYTES, PARTS = 8 << 20, 64
_TOKEN_BIN = 64  # code points: tokens and spans meet in the bins that they touch


def mode_of(value: Column) -> Column:
    """The mode that a name stands for; null replaces everywhere."""
    name = F.lower(T.strip(value))
    out = F.lit(None).cast("string")
    for mode, names in MODES.items():
        out = F.when(name.isin(*names), mode).otherwise(out)
    return out


def parse_entries(raw: DataFrame) -> DataFrame:
    """Entries (base, pattern, reading, mode) of raw ones (base, pattern, reading, kana, regex, mode): a pattern, a base marked as one, or a literal; others go."""
    filled = lambda c: F.coalesce(T.strip(F.col(c)), F.lit(""))
    base, given = filled("base"), filled("pattern")
    reading = F.when(F.coalesce("reading", F.lit("")) != "", filled("reading")).otherwise(filled("kana"))
    marked = F.regexp_extract(base, r"(?is)^(?:re|regex):(.*)$", 1)
    is_marked = base.rlike("(?i)^(re|regex):")
    pattern = F.when(given != "", given).when(F.coalesce("regex", F.lit(False)), base).when(is_marked, T.strip(marked))
    out = raw.withColumn("__p", F.nullif(pattern, F.lit(""))).withColumn("__r", reading).withColumn("__drop", (F.col("__r") == "") | F.col("__p").isNull() & (is_marked | (base == "")))
    out = out.filter(~F.col("__drop")).withColumn("base", F.when(F.col("__p").isNull(), base)).withColumn("mode", F.when(F.col("__p").isNull(), mode_of(F.col("mode"))))
    return out.withColumn("pattern", F.col("__p")).withColumn("reading", F.col("__r")).drop("__p", "__r", "__drop", "kana", "regex")


def entry_line(base: Column, pattern: Column, reading: Column) -> Column:
    """An entry as a line of an override file; empty if there is nothing to say."""
    filled = lambda c: F.coalesce(T.strip(c), F.lit(""))
    return F.when(filled(reading) == "", "").when(filled(pattern) != "", F.concat(F.lit("re:"), filled(pattern), F.lit("="), filled(reading))).when(filled(base) != "", F.concat(filled(base), F.lit("="), filled(reading))).otherwise("")


def entries_text(entries: DataFrame, by: list[str]) -> DataFrame:
    """One text of lines for the entries (ord, base, pattern, reading) of each group."""
    own = entries.withColumn("line", entry_line(F.col("base"), F.col("pattern"), F.col("reading"))).filter("line <> ''")
    rows = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return own.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x.line), "\n").alias("text"))


def add_comments(text: Column, comments: Column) -> Column:
    """An override text with the comments (array) that it doesn't hold yet, as comment or as entry, below it behind a blank line."""
    body = F.regexp_replace(F.regexp_replace(T.unify_breaks(F.coalesce(text, F.lit(""))), r"(?m)[^\S\n]+$", ""), r"^\n+|\n+$", "")
    lines = F.transform(F.split(body, "\n"), T.strip)
    known = F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: T.strip(F.substring(x, F.lit(2), F.length(x))))
    sep = lambda x: F.when(F.contains(x, F.lit("＝")), F.lit("＝")).when(F.contains(x, F.lit("=")), F.lit("=")).otherwise(F.lit("\t"))
    sides = lambda x: F.concat(F.lit(r"^(?:[-*•] )?(.*?)\s*"), sep(x), F.lit(r"\s*"))
    pair = lambda x: F.regexp_replace(x, sides(x), F.lit("$1="))
    entries = F.transform(F.filter(lines, lambda x: ~x.startswith("#")), pair)
    new = F.filter(F.transform(comments, T.strip), lambda x: (x != "") & ~F.array_contains(known, x) & ~F.array_contains(entries, x))
    added = F.array_join(F.transform(new, lambda x: F.concat(F.lit("# "), x)), "\n")
    return F.when(F.size(new) == 0, body).when(body == "", added).otherwise(F.concat(body, F.lit("\n\n"), added))


def _literally(reading: Column) -> Column:
    return F.regexp_replace(reading, r"([\\$])", r"\\$1")


def replace_first(text: Column, base: Column, reading: Column) -> Column:
    at = F.instr(text, base)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), reading, F.substring(text, at + F.length(base), F.length(text)))).otherwise(text)


def replace_isolated(text: Column, base: Column, reading: Column) -> Column:
    """A one-character base where it is a word of its own: nothing Japanese beside it but marks, blanks and particles, or a copula behind it and no kanji before.

    A particle that goes on in hiragana is the word's own ending. Longer bases are replaced everywhere.
    """
    x = escape_pattern(base)
    alone = F.concat(F.lit(f"(?:(?<![{T.KANJI}])(?="), x, F.lit(f"[{COPULAS}])|(?<!{_BLOCKS})(?="), x, F.lit(f"(?!{_BLOCKS})))"), x, F.lit(rf"(?![{PARTICLES}][\x{{3040}}-\x{{309F}}])"))
    return F.when(F.length(base) != 1, F.replace(text, base, reading)).when(F.contains(text, base), F.regexp_replace(text, alone, _literally(reading))).otherwise(text)


def replace_at_kanji_boundary(text: Column, base: Column, reading: Column) -> Column:
    """A one-character base with no kanji beside it; longer bases everywhere."""
    kanji = f"[{T.KANJI}{SAFE_MARKS}]"
    pattern = F.concat(F.lit(f"(?<!{kanji})"), escape_pattern(base), F.lit(f"(?!{kanji})"))
    return F.when(F.length(base) != 1, F.replace(text, base, reading)).when(F.contains(text, base), F.regexp_replace(text, pattern, _literally(reading))).otherwise(text)


@F.pandas_udf(StringType())
def _patterns(texts: pd.Series, patterns: pd.Series, readings: pd.Series) -> pd.Series:
    """Patterns in the dialect of Python's re, in order; one that doesn't compile or fit its reading is passed over."""

    def one(text, *entries):
        if text is not None and entries[0] is not None:
            for pattern, reading in zip(*entries, strict=True):
                with contextlib.suppress(re.error, IndexError):
                    text = re.sub(pattern, reading, text)
        return text

    return pd.Series([one(*row) for row in zip(texts, patterns, readings, strict=True)], dtype=object)


def apply_entries(text: Column, literals: Column) -> Column:
    """The literal entries (array of struct base, reading, mode), in the order given, each on what the one before has left."""
    x = lambda f, t, e: f(t, e.base, e.reading)
    step = lambda t, e: F.when(e.mode == "first", x(replace_first, t, e)).when(e.mode == "isolated", x(replace_isolated, t, e)).when(e.mode == "kanji", x(replace_at_kanji_boundary, t, e)).otherwise(x(F.replace, t, e))
    return F.aggregate(literals, text, step)


def apply_overrides(texts: DataFrame, entries: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """texts with the overrides (*by, ord, base, pattern, reading, mode) of their group applied: literals, longest base first and then by ord, then patterns by ord.

    A group's entries, one book's dictionary, are one row. Dictionaries of up to SENT_BYTES in all (measured) are sent to the texts, which stay where they are; else the
    texts meet them by an equi-join, dealt by their group and PARTS hashes, so that a book's texts don't go to one task. Texts of a group without
    entries stay as they are, as do null texts. Without any pattern among the entries (looked for) nothing passes through Python.
    """
    own = entries.filter("reading <> '' AND coalesce(pattern, base, '') <> ''")
    literal = F.when(F.coalesce("pattern", F.lit("")) == "", F.struct((-F.length("base")).alias("k"), "ord", "base", "reading", "mode"))
    pattern = F.when(F.coalesce("pattern", F.lit("")) != "", F.struct("ord", "pattern", "reading"))
    lists = own.groupBy(*by).agg(F.array_sort(F.collect_list(literal)).alias("__literals"), F.array_sort(F.collect_list(pattern)).alias("__patterns"))
    filled = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("base", "pattern", "reading")]
    size, patterns = own.agg(F.coalesce(F.sum(sum(filled, F.lit(64))), F.lit(0)), F.coalesce(F.max((F.coalesce("pattern", F.lit("")) != "").cast("int")), F.lit(0))).first()
    if size <= SENT_BYTES:
        both = texts.join(F.broadcast(lists), by, "left")
    else:
        dealt = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        both = texts.withColumn("__salt", F.pmod(F.xxhash64(*(c for c, kind in texts.dtypes if "map<" not in kind)), F.lit(PARTS)).cast("int")).join(dealt.hint("merge"), [*by, "__salt"], "left")
    done = both.withColumn(text, F.when(F.col("__literals").isNotNull(), apply_entries(F.col(text), F.col("__literals"))).otherwise(F.col(text)))
    if patterns:
        done = done.withColumn(text, _patterns(F.col(text), F.col("__patterns.pattern"), F.col("__patterns.reading")))
    return done.select(*texts.columns)


def surfaces(texts: DataFrame, spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans (chapter, id, start, end) with the surface of the tokens (chapter, start, end) that they overlap, from the first one's start to the last one's end; without tokens their own text."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / _TOKEN_BIN), F.floor((F.col(e) - 1) / _TOKEN_BIN)))
    t = tokens.filter("end > start").select("chapter", F.col("start").alias("t_start"), F.col("end").alias("t_end")).withColumn("bin", bins("t_start", "t_end"))
    s = spans.filter("start >= 0 AND end > start").select("chapter", "id", "start", "end").withColumn("bin", bins("start", "end"))
    met = s.join(t, ["chapter", "bin"]).filter((F.col("t_start") < F.col("end")) & (F.col("t_end") > F.col("start")))
    reach = met.groupBy("chapter", "id").agg(F.min("t_start").alias("lo"), F.max("t_end").alias("hi"))
    own = spans.join(reach, ["chapter", "id"], "left").join(texts.select("chapter", F.col("text").alias("__text")), "chapter")
    cut = lambda a, b: T.strip(F.substring("__text", a.cast("int") + 1, (b - a).cast("int")))
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("__text"))
    wide = cut(F.col("lo"), F.col("hi"))
    surface = F.when(inside & (wide != ""), wide).when(inside, cut(F.col("start"), F.col("end"))).otherwise("")
    return own.withColumn("surface", surface).drop("lo", "hi", "__text")


def context_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How often a base has a reading within a surface."""
    return pairs.groupBy(*by, "base", "surface", "reading").agg(F.count(F.lit(1)).alias("n"))


def normal_classes(blocks: DataFrame, by: list[str], key: str) -> DataFrame:
    """The usual paragraph classes of a document: of the most frequent one, if it has eight or more, those of at least a fifth and three; else all."""
    counts = blocks.filter(F.coalesce(key, F.lit("")) != "").groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(*by).agg(F.max("n").alias("most"))
    least = F.when(F.col("most") >= 8, F.greatest(F.lit(3), F.floor(F.col("most") / 5))).otherwise(1)
    return counts.join(most, by).filter(F.col("n") >= least).drop("most")


_RAW = ("base", "pattern", "reading", "kana")


def _unnest(rows: DataFrame, value: str, key: str, place: str) -> DataFrame:
    """rows with the members of a VARIANT column: `key`, `place` and `value` of each; rows without members go."""
    tvf = rows.sparkSession.tvf.variant_explode(F.col(value).outer())
    return rows.lateralJoin(tvf.select(F.col("pos").alias(place), F.col("key").alias(key), F.col("value").alias("__member"))).drop(value).withColumnRenamed("__member", value)


def _is(value: str, kind: str) -> Column:
    return F.schema_of_variant(F.col(value)).startswith(kind)


def book_overrides(books: DataFrame) -> DataFrame:
    """(book, chapter, ord, base, pattern, reading, mode) of override files (book, data: JSON); chapter is null for entries of the whole book.

    Entries of the book stand under `global`, `default` or `*`, the first of these that has any counts. Those of chapters stand under `chapters`, or the file is a map of
    chapters itself, if it has none of these keys. A list of entries may be wrapped in `replacements` or `entries`, and an entry is an object or a pair. A base of one sign
    without a mode of its own is replaced where it is isolated. Null and invalid files, and entries without a reading, give no rows.
    """
    v = books.select("book", F.try_parse_json("data").alias("v")).filter("v IS NOT NULL").filter(_is("v", "OBJECT"))
    part = lambda path: F.try_variant_get("v", path, "variant")
    known = part('$["global"]').isNotNull() | part('$["default"]').isNotNull() | part('$["*"]').isNotNull()
    whole = [v.select("book", F.lit(None).cast("string").alias("chapter"), F.lit(i).alias("rank"), part(f'$["{k}"]').alias("e")) for i, k in enumerate(("global", "default", "*"))]
    by_chapter = F.when(part('$["chapters"]').isNotNull(), part('$["chapters"]')).when(~known, F.col("v"))
    named = _unnest(v.select("book", by_chapter.alias("e")).filter("e IS NOT NULL").filter(_is("e", "OBJECT")), "e", "chapter", "__p").select("book", "chapter", F.lit(9).alias("rank"), "e")
    lists = whole[0].unionByName(whole[1]).unionByName(whole[2]).unionByName(named).filter("e IS NOT NULL")
    inner = lambda k: F.try_variant_get("e", f"$.{k}", "variant")
    some = lambda k: inner(k).isNotNull() & (F.schema_of_variant(inner(k)) != "ARRAY<VOID>")
    lists = lists.withColumn("e", F.when(_is("e", "OBJECT"), F.when(some("replacements"), inner("replacements")).otherwise(inner("entries"))).otherwise(F.col("e"))).filter("e IS NOT NULL").filter(_is("e", "ARRAY"))
    items = _unnest(lists, "e", "__k", "ord").filter("e IS NOT NULL")
    text = lambda p: F.try_variant_get("e", p, "string")
    pair = _is("e", "ARRAY")
    given = inner("mode").isNotNull() | inner("scope").isNotNull()
    raw = items.select(
        "book", "chapter", "rank", "ord", F.when(pair, text("$[0]")).otherwise(text("$.base")).alias("base"), text("$.pattern").alias("pattern"), F.when(pair, text("$[1]")).otherwise(text("$.reading")).alias("reading"), text("$.kana").alias("kana"),
        F.try_variant_get("e", "$.regex", "boolean").alias("regex"), F.coalesce(F.nullif(text("$.mode"), F.lit("")), text("$.scope")).alias("mode"), given.alias("given"),
    )
    got = parse_entries(raw)
    alone = F.col("mode").isNull() & ~F.col("given") & (F.length("base") == 1)
    got = got.withColumn("mode", F.when(alone, "isolated").otherwise(F.col("mode")))
    first = got.filter("rank < 9").groupBy("book").agg(F.min("rank").alias("first"))
    return got.join(first, "book", "left").filter("rank = 9 OR rank = first").select("book", "chapter", "ord", "base", "pattern", "reading", "mode")
