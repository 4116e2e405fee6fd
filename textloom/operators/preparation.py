"""What a chunk is read as: ruby evidence, reading overrides, numbers, and the ordered clean-up before synthesis."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as T
from textloom.functions.spoken import speak_numbers
from textloom.functions.unicode import compatible, nfkc
from textloom.operators import overrides as O
from textloom.operators import spans as S


def reading_script(reading: Column) -> Column:
    """A reading in compatibility form; in hiragana, unless it is written in katakana alone."""
    form = nfkc(reading)
    katakana = form.rlike(r"[\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}]") & ~form.rlike(r"[\x{3040}-\x{309F}]")
    return F.when(katakana, form).otherwise(T.to_hiragana(form))


def modern_forms(text: Column, old: str, new: str) -> Column:
    """Old forms of kanji as new ones, sign by sign; the table is the caller's."""
    return F.translate(text, old, new) if old else text


def prepare(text: Column, *, short_stops: bool = False, old: str = "", new: str = "") -> Column:
    """The text as it is synthesised, by steps whose order matters.

    Compatibility forms, new kanji, runs of dashes as one blank, no format characters, (short_stops) full stops behind lines, no quotation marks but apostrophes,
    long ellipses as one, wave dashes, blanks as one, blanks between Japanese signs as pauses (no full stop where a run of dashes was), (short_stops) a final full stop.
    A null text is an empty one.
    """
    run = r"[\x{2010}-\x{2015}\x{2500}\x{2501}]{2,}"  # text.DASHES

    def blanks(t: Column, dashed: Column) -> Column:
        one = T.strip(F.regexp_replace(t, r"[\s\x{3000}]+", " "))
        return T.let(one, lambda x: F.when(dashed, T.space_to_pause(x, full_stop=False)).otherwise(T.space_to_pause(x)))

    stop = (lambda t: T.let(t, T.tail_stop)) if short_stops else (lambda t: t)

    def steps(t: Column) -> Column:
        bare = T.without_format_characters(F.regexp_replace(t, run, " "))
        plain = T.without_single_quotes(T.without_double_quotes(T.without_japanese_quotes(stop(bare))))
        return T.let(T.wave_dashes(T.short_ellipsis(plain)), lambda x: blanks(x, t.rlike(run)))

    # most texts have none of the signs that the steps before the blanks are about; one look tells
    done = T.let(modern_forms(nfkc(F.coalesce(text, F.lit(""))), old, new), lambda t: F.when(t.rlike(f"[^{T.PLAIN}]"), steps(t)).otherwise(T.let(stop(t), lambda x: blanks(x, F.lit(False)))))
    return T.let(done, T.final_stop) if short_stops else done


@lru_cache(1 << 12)
def _script(reading: str) -> str:
    """As reading_script."""
    form = compatible(reading)
    return form if _KATAKANA.search(form) and not _HIRAGANA.search(form) else form.translate(_TO_HIRAGANA)


_KATAKANA, _HIRAGANA, _TO_HIRAGANA = S.signs(r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}"), S.signs(r"\x{3040}-\x{309F}"), T.to_hiragana_map()
_KANJI, _KANA, _BREAKS = S.signs(T.KANJI), S.signs(T.KANA, "*"), S.signs(f"\n{T.SECTION}")


@lru_cache(1 << 12)
def _suspicious(base: str, reading: str) -> bool:
    """As text.is_suspicious."""
    return not base.strip(" ") or not reading.strip(" ") or bool(_KANJI.search(reading) or _BREAKS.search(base) or _BREAKS.search(reading)) or len(reading) > max(24, 6 * len(base))


def _read_out(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """The text with its spans (start, end, base, reading) replaced by their readings from right to left, where the base stands at the span; a sign is copied once, but where spans overlap.

    Spans of one kanji read in kana, each starting where the one before ends, are one span with bases and readings joined.
    """
    runs: list[list] = []
    last = False
    for start, end, reading, base in sorted((a, b, r, x) for a, b, x, r in spans):
        one = len(base) == 1 and bool(_KANJI.match(base) and _KANA.fullmatch(reading))
        if one and last and runs[-1][4] == start:
            runs[-1][1], runs[-1][2], runs[-1][3], runs[-1][4] = max(runs[-1][1], end), runs[-1][2] + base, runs[-1][3] + reading, end
        else:
            runs.append([start, end, base, reading, end])
        last = one
    good = sorted((a, b, x, _script(r)) for a, b, x, r, _ in runs if not _suspicious(x, r))
    done: list[str] = []  # what stands behind `at`, from right to left
    at = len(text)
    for start, end, base, reading in reversed(good):
        if end > at:  # spans overlap: what stands there is looked at as it is by now
            done = ["".join(reversed(done))]
            beyond = end - at
            if start <= at and text[start:at] + done[0][:beyond] == base:
                done = [done[0][beyond:], reading]
                at = start
            elif start > at and done[0][start - at : beyond] == base:
                done = [done[0][: start - at] + reading + done[0][beyond:]]
        elif text[start:end] == base:
            done += [text[end:at], reading]
            at = start
    return text[:at] + "".join(reversed(done))


@F.pandas_udf(StringType())
def _evidence(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for texts, *columns in batches:
        rows = zip(texts, *columns, strict=True)
        yield pd.Series([t if t is None or s is None else _read_out(t, [x for x in zip(s.tolist(), e.tolist(), b, r, strict=True) if x[2] is not None]) for t, s, e, b, r in rows], dtype=object)


def ruby_evidence(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """chunks (chapter, chunk, start, end, text) with the chapter's ruby spans (chapter, start, end, base, reading) that lie within them read out.

    A span meets its chunk in one pass over both in order. Runs of one-kanji spans are one span, suspicious readings don't count, and spans whose base doesn't stand in the text change nothing.
    The spans of a chunk meet its text as one row.
    """
    inside = S.contained(spans.select("chapter", "start", "end", "base", "reading").filter("reading <> ''"), chunks.select("chapter", "chunk", "start", "end"))
    sets = inside.groupBy("chapter", "chunk").agg(F.collect_list(F.struct("start", "end", "base", "reading")).alias("__s"))
    both = chunks.join(sets, ["chapter", "chunk"], "left")
    return both.withColumn("text", _evidence("text", "__s.start", "__s.end", "__s.base", "__s.reading")).drop("__s")


def pipeline(chunks: DataFrame, spans: DataFrame, book_entries: DataFrame, entries: DataFrame, *, short_stops: bool = True) -> DataFrame:
    """(book, chapter, chunk, ruby_text, after_overrides, after_numbers, prepared) of chunks (book, chapter, chunk, start, end, text).

    Ruby spans of the chapter come first, then the readings that the book's ruby gives to bases anywhere (book_entries: book, ord, base, pattern, reading, mode),
    but for bases that the overrides (entries, of the same columns) have, then the overrides, then numbers, then the clean-up.
    """
    t = ruby_evidence(chunks.select("book", "chapter", "chunk", "start", "end", "text"), spans)
    taken = entries.select("book", F.trim("base").alias("base")).filter("base <> ''").distinct()
    own = book_entries.withColumn("__base", F.trim("base")).join(taken.withColumnRenamed("base", "__base"), ["book", "__base"], "left_anti").drop("__base").withColumn("reading", reading_script(F.col("reading")))
    t = O.apply_overrides(t, own, ["book"]).withColumn("ruby_text", F.col("text"))
    t = O.apply_overrides(t, entries, ["book"]).withColumn("after_overrides", F.col("text"))
    t = t.withColumn("after_numbers", speak_numbers("after_overrides"))
    return t.select("book", "chapter", "chunk", "ruby_text", "after_overrides", "after_numbers", prepare(F.col("after_numbers"), short_stops=short_stops).alias("prepared"))
