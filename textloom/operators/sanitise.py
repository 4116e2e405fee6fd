"""The whole cleaning of a book's chapters: rules on titles and texts, sections, casing, and the ruby spans carried through all of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import casing, sections, tracking
from textloom.shared import written


@dataclass(frozen=True)
class Rules:
    """Patterns, in order: titles of chapters to drop, where a text ends, what is removed from it."""

    drop: list[str] = field(default_factory=list)
    cutoff: list[str] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)


def steps(rules: Rules, headings: Column) -> list[Callable[[Column], Column]]:
    """How a text is cleaned: normalised with sections, cut off, rid of what the rules remove, and normalised again; then small capitals and lines in capitals. What the rules learn of a text they learn within its row."""
    cut = lambda t: T.let(T.cutoff(t, rules.cutoff)[0], lambda x: T.remove_all(x, rules.remove)[0])
    return [T.clean, sections.sectioned, cut, T.clean, sections.sectioned, casing.small_capitals_of, lambda t: casing.capital_lines_of(t, headings)]


def sanitise(chapters: DataFrame, spans: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Clean chapters (chapter, title, text, headings) and their spans (chapter, start, end, base, reading).

    1. (chapter, title, reason, why, text, raw_chars, clean_chars): reason is the pattern that drops a chapter, whose text is null then, why the one that cuts its text off.
       Texts are normalised, cut and rid of what the rules remove; small capitals and lines in capitals are respelled by the chapter's own words.
    2. (chapter, start, end, base, reading, how): where the spans are in the clean text. The same rules are run on each chapter with markers
       around its spans, as often as with bases and with readings; where that changes what they do, the difference of the two clean texts is taken.

    Null titles and texts are read as empty ones; chapter must be unique. An empty table gives empty tables.
    """
    own = chapters.select("chapter", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "headings")
    own = own.withColumn("reason", T.drop_reason(F.col("title"), rules.drop)).withColumn("why", T.let(T.clean(F.col("text")), lambda t: T.cutoff(t, rules.cutoff)[1]))
    clean = tracking.by_rows(*steps(rules, F.col("headings")))
    found = written(tracking.tracked(own.filter("reason = ''").select("chapter", "text", "headings"), spans, clean))
    texts = own.select("chapter", "title", "reason", "why", F.length("text").alias("raw_chars")).join(found.select("chapter", F.col("cleaned").alias("text")), "chapter", "left")
    return texts.withColumn("clean_chars", F.coalesce(F.length("text"), F.lit(0))), tracking.spans_from(found)
