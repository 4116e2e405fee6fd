"""Spans carried through the cleaning of their text, and spans found again from what two versions of a text differ in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from textloom.functions import alignment as A
from textloom.functions import text as T
from textloom.functions.html import RUBY, STRING, struct_of
from textloom.shared import written



@F.pandas_udf(struct_of(base=STRING, ruby=STRING, free=BooleanType()))
def _marked(texts: pd.Series, starts: pd.Series, ends: pd.Series, bases: pd.Series, readings: pd.Series) -> pd.DataFrame:
    """The text with markers, null where it has none, and whether neither it nor a reading holds a marker's sign."""
    out = []
    for t, *columns in zip(texts, starts, ends, bases, readings, strict=True):
        spans = [] if columns[0] is None else A.apart(t, zip(*(c.tolist() for c in columns), strict=True))
        free = not (A.HELD.search(t) or any(A.HELD.search(r) for *_, r in spans))
        out.append((A.mark(t, spans, False), A.mark(t, spans, True), True) if free and spans else (None, None, free))
    return pd.DataFrame(out, columns=["base", "ruby", "free"])


def _unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last columns are b and r with plain, ruby and spans in their place."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base", pa.string()), ("reading", pa.string())]))
    for batch in batches:
        out = []
        for b, r in zip(batch["b"].to_pylist(), batch["r"].to_pylist(), strict=True):
            (plain, at), (spoken, there) = A.unmark(b), A.unmark(r)
            both = sorted((*at[k], plain[slice(*at[k])], spoken[slice(*there[k])]) for k in at.keys() & there.keys())
            out.append((plain, spoken, [dict(zip(("start", "end", "base", "reading"), x, strict=True)) for x in both if x[2] and x[3]]))
        new = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), kind))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=[*batch.schema.names[:-2], "plain", "ruby", "spans"])


class by_rows:  # noqa: N801
    """Rules for one text, a column, as a rule for a table of texts (doc, text), one step after the other. `tracked` takes them where the texts are; there they may also name other columns of theirs."""

    def __init__(self, *steps: Callable[[Column], Column]):
        self.steps = steps

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:  # one step a projection: Spark resolves functions within functions level by level, and not without end
            df = df.select("doc", step(F.col("text")).alias("text"))
        return df


def tracked(texts: DataFrame, spans: DataFrame, clean: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Spans (chapter, start, end, base, reading) of texts (chapter, text) in the cleaned texts: chapter, cleaned, spoken, tracked, spans.

    clean makes texts (doc, text) into cleaned ones, each by itself; by_rows makes one of a rule for columns.

    Spans that don't fit their text are left out, an empty base is read from the text, and of overlapping ones the first stays. The text is cleaned three times:
    as it is, with numbered private-use markers around bases, and with markers around the readings in their place. If the marked
    text without its markers is the cleaned one, but for case, the markers say where each span is now; spans that lost a marker or became
    suspicious go. Otherwise tracked is false, spans is null, and `spoken` (the cleaned text with readings) serves diff_spans. A text or span
    that holds a marker's sign is not tracked. Null texts are read as empty ones. Any rule of `clean` may delete, join or rewrite: nothing is assumed of it.
    """
    # the spans of a chapter meet its text as one row; texts are few bytes for their work, so that a number of partitions is given
    t = texts.filter("chapter IS NOT NULL").withColumn("text", F.coalesce("text", F.lit(""))).repartition(2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chapter")
    row = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "base", "reading")
    sets = spans.filter("start IS NOT NULL AND end IS NOT NULL AND reading IS NOT NULL").groupBy("chapter").agg(F.collect_list(row).alias("__s"))
    own = t.join(sets, "chapter", "left").withColumn("__m", _marked("text", "__s.start", "__s.end", "__s.base", "__s.reading"))
    three = F.array("text", F.coalesce("__m.base", "text"), F.coalesce("__m.ruby", "text"))
    if isinstance(clean, by_rows):  # the versions stay in their row; where nothing is marked they are one
        own = own.withColumn("__v", F.when(F.col("__m.base").isNull(), F.array("text")).otherwise(three))
        for step in clean.steps:  # named twice, so that Spark leaves each step a projection: one expression of them all takes it half a minute to plan
            own = own.withColumn("__v", F.when(F.col("__v").isNotNull(), F.transform("__v", step)))
        version = lambda k: F.coalesce(F.get("__v", F.lit(k)), F.get("__v", F.lit(0)))
        done = own.select("chapter", F.col("__m.free").alias("free"), version(0).alias("cleaned"), version(1).alias("b"), version(2).alias("r"))
    else:  # the three versions of a chapter are texts of their own to the rules
        rows = written(own.select("chapter", F.col("__m.free").alias("free"), F.posexplode(three).alias("v", "text")))
        out = clean(rows.select(F.struct("chapter", "v").alias("doc"), "text")).select("doc.*", "text")
        version = lambda k: F.max(F.when(F.col("v") == k, F.col("text")))
        met = out.groupBy("chapter").agg(version(0).alias("cleaned"), version(1).alias("b"), version(2).alias("r"))
        done = rows.filter("v = 0").select("chapter", "free").join(met, "chapter")
    done = done.select("chapter", "free", "cleaned", "b", "r")
    # a step over rows: the versions are cleaned once, however often their parts are named behind it
    done = done.mapInArrow(_unmarked, StructType([*done.schema.fields[:-2], StructField("plain", STRING), StructField("ruby", STRING), StructField("spans", RUBY)]))
    same = F.col("free") & (F.length("plain") == F.length("cleaned")) & (F.lower("plain") == F.lower("cleaned"))
    kept = F.filter("spans", lambda x: ~T.is_suspicious(x.base, x.reading))
    return done.select("chapter", "cleaned", F.col("ruby").alias("spoken"), same.alias("tracked"), F.when(same, kept).alias("spans"))


@F.pandas_udf(RUBY)
def _replaced(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(a: str, b: str, at: int) -> list[dict]:
        found = (x for i0, i1, j0, j1 in A.replacements(a, b) for x in A.split_on_kana(at + i0, a[i0:i1], b[j0:j1]))
        return [dict(zip(("start", "end", "base", "reading"), x, strict=True)) for x in found]

    for plain, ruby, at in batches:
        yield pd.Series([one(*row) for row in zip(plain, ruby, at, strict=True)])


@F.pandas_udf(ArrayType(struct_of(plain_at=IntegerType(), plain=STRING, ruby=STRING)))
def _gaps(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for plain, ruby in batches:
        yield pd.Series([[dict(zip(("plain_at", "plain", "ruby"), x, strict=True)) for x in A.gaps(a, b)] for a, b in zip(plain, ruby, strict=True)], dtype=object)


def diff_spans(texts: DataFrame) -> DataFrame:
    """Spans (chapter, start, end, base, reading) of what `ruby` has in place of parts of `plain`, from rows (chapter, plain, ruby).

    Pieces that occur once on both sides, and whose order agrees with all others before and behind them, are anchors. What lies between two anchors and differs is a gap, a row of its
    own, and all that is shuffled; an edit script is made for each gap, and replaced parts that mix kanji and kana are divided at the kana. Spans of suspicious readings
    are left out. Null texts are read as empty. chapter must be unique; a chapter's gaps are spread over tasks.
    """
    t = texts.filter("chapter IS NOT NULL").select("chapter", F.coalesce("plain", F.lit("")).alias("plain"), F.coalesce("ruby", F.lit("")).alias("ruby"))
    # gaps are small in bytes and much work: without a number of partitions they would come together in few tasks
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    differ = t.filter("plain <> ruby").select("chapter", F.inline(_gaps("plain", "ruby"))).repartition(parts)
    found = differ.select("chapter", F.explode(_replaced("plain", "ruby", "plain_at")).alias("x")).select("chapter", "x.*")
    return found.filter(~T.is_suspicious(F.col("base"), F.col("reading")))


def clean_spans(texts: DataFrame, spans: DataFrame, clean: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Spans in the cleaned texts: tracked ones where tracking holds, else those of the difference. chapter, start, end, base, reading, how."""
    return spans_from(written(tracked(texts, spans, clean)))


def spans_from(all_: DataFrame) -> DataFrame:
    """As clean_spans, from a written result of tracked."""
    kept = all_.filter("tracked").select("chapter", F.explode("spans").alias("x")).select("chapter", "x.*", F.lit("tracked").alias("how"))
    lost = all_.filter("NOT tracked").select("chapter", F.col("cleaned").alias("plain"), F.col("spoken").alias("ruby"))
    return kept.unionByName(diff_spans(lost).withColumn("how", F.lit("difference")))
