"""Small capitals at the heads of paragraphs, which extraction turns into capitals, as the document itself spells the words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

WORD = r"\p{L}[\p{L}\p{M}'’\-]*+"
LEAST, MOST = 2, 6  # words of a run

# Words that stay small inside a run, and abbreviations that stay capital.
STOP_WORDS = (
    "a an and are as at be been being before but by did do does for from had has have he her hers him his how i if in into is it its me my no nor not of on or our ours she so that the their theirs them then there these they this those "
    "to us was we were what when where which who why with without you your yours"
).split()
ABBREVIATIONS = "abc bbc cbs cia cnn dna eu fbi hiv irs mlb nba nfl nato nasa nhl rna uk un usa".split()
VOWELS = "aeiouyāīūṛṝḷḹ"


def _blocks(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def _run(block: Column) -> Column:
    """The words of a paragraph's leading run of capitals, if it may be one of small capitals: LEAST to MOST words before one with a small letter."""
    head = F.regexp_extract(block, rf"^(?:\P{{L}}*+{WORD}){{1,{MOST + 1}}}", 0)  # no further than the words that tell
    none = F.array().cast("array<string>")

    def fits(words: Column) -> Column:
        # the place of the first word that isn't in capitals; a longer run counts up to MOST words, and the next one must have a small letter
        at = F.array_position(F.transform(words, lambda w: ~T.is_all_caps(w)), True)
        return T.let(F.when(at == 0, F.size(words)).otherwise(at - 1).cast("int"), lambda n: F.when((n >= LEAST) & (n <= MOST) & (n < F.size(words)) & F.coalesce(F.get(words, n).rlike(r"\p{Ll}"), F.lit(False)), F.slice(words, F.lit(1), n)).otherwise(none))

    capital = block.rlike(r"^\P{L}*+\p{Lu}(?![\p{M}'’\-]*+[\p{L}&&[^\p{Lu}]])")  # the first two letters tell that most blocks have none
    return F.when(capital & block.rlike("[a-z]"), T.let(F.regexp_extract_all(head, F.lit(f"({WORD})"), F.lit(0)), fits)).otherwise(none)


def _title(w: Column) -> Column:
    """Each part of a word between hyphens and apostrophes with a large first letter."""
    return F.array_join(F.transform(F.split(w, "(?<=[-'’])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def _spelled(w: Column, first: Column, spellings: Column) -> Column:
    low = F.lower(w)
    known = F.try_element_at(spellings, low)
    large = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    stays = low.isin(*ABBREVIATIONS) | w.rlike("^[IVXLCDM]+$") | (F.length(w) <= 3) | ((F.length(w) <= 4) & ~low.rlike(f"[{VOWELS}]"))
    mapped = F.when(first & known.rlike(r"^[^\p{Lu}]*$"), large(known)).otherwise(known)
    return F.when(known.isNotNull(), mapped).when(low.isin(*STOP_WORDS), F.when(first, large(low)).otherwise(low)).when(stays, w).when(first, _title(w)).otherwise(low)


def _repaired(block: Column, spellings: Column) -> Column:
    """The block with its run respelled: word by word, what stands before a word and the word move from the rest to the part that is done."""
    start = F.struct(F.lit("").alias("done"), block.alias("rest"))

    def step(a: Column, w: Column) -> Column:
        # before the first word nothing is done yet; a block may begin with a sign, which is then done with it
        return T.let(F.call_function("instr", a.rest, w), lambda at: F.struct(F.concat(a.done, F.substring(a.rest, F.lit(1), at - 1), _spelled(w, a.done == "", spellings)).alias("done"), F.substring(a.rest, at + F.length(w), F.length(a.rest)).alias("rest")))

    def repaired(run: Column) -> Column:
        sign = F.exists(run, lambda w: F.map_contains_key(spellings, F.lower(w)) | F.lower(w).isin(*STOP_WORDS))
        return F.when((F.size(run) > 0) & sign, F.aggregate(run, start, step, lambda a: F.concat(a.done, a.rest))).otherwise(block)

    return T.let(_run(block), repaired)


def spellings(texts: DataFrame) -> DataFrame:
    """(doc, m): a map from lower-case words to how each text (doc, text, keys) spells them with a small letter most often (ties: Title, lower, other, then the first), for the words asked for (keys, an array).

    Words that aren't asked for are left out within their text, so that only counts of the others are shuffled.
    """
    asked = lambda w: w.rlike(r"\p{Ll}") & F.array_contains("keys", F.lower(w))
    words = texts.filter(F.size("keys") > 0).select("doc", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0)), asked)).alias("pos", "w"))
    counts = words.withColumn("key", F.lower("w")).groupBy("doc", "key", "w").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    score = F.when(F.col("w").rlike(r"^\p{Lu}.*\p{Ll}"), 3).when(~F.col("w").rlike(r"\p{Lu}"), 2).otherwise(1)
    best = counts.groupBy("doc", "key").agg(F.min_by("w", F.struct(-F.col("n"), -score, "first")).alias("spelling"))
    return best.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("key", "spelling"))).alias("m"))


def _with_map(texts: DataFrame, words: Column) -> DataFrame:
    """texts with the spellings m of the words that an array names; an empty map where there is none."""
    maps = spellings(texts.select("doc", "text", F.array_distinct(F.transform(words, F.lower)).alias("keys")))
    return texts.join(maps, "doc", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string, string>")))


def spellings_of(text: Column, words: Column) -> Column:
    """As spellings, the map of one text within its row, for an array of words. Without any that map is empty, and the text isn't looked through."""
    none = F.create_map().cast("map<string, string>")
    spelled = lambda keys: F.filter(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0)), lambda w: F.array_contains(keys, F.lower(w)) & w.rlike(r"\p{Ll}"))
    # equal spellings stand side by side, in the order of their places; the first of each with the place of the next one's tells how many there are
    sort = lambda ws: F.array_sort(F.transform(ws, lambda w, i: F.struct(F.lower(w).alias("key"), w.alias("w"), i.alias("i"))))
    heads = lambda es: F.filter(F.transform(es, lambda e, i: F.struct(e.alias("e"), i.alias("at"))), lambda h: (h["at"] == 0) | (F.get(es, h["at"] - 1).w != h.e.w))
    score = lambda w: F.when(w.rlike(r"^\p{Lu}.*\p{Ll}"), 3).when(~w.rlike(r"\p{Lu}"), 2).otherwise(1)
    many = lambda hs, j, size: F.coalesce(F.get(hs, j + 1)["at"], size) - F.get(hs, j)["at"]
    ranked = lambda hs, size: F.array_sort(F.transform(hs, lambda h, j: F.struct(h.e.key.alias("key"), (-many(hs, j, size)).alias("n"), (-score(h.e.w)).alias("s"), h.e.i.alias("first"), h.e.w.alias("w"))))
    best = lambda rs: F.map_from_entries(F.transform(F.filter(rs, lambda r, j: (j == 0) | (F.get(rs, j - 1).key != r.key)), lambda r: F.struct(r.key, r.w)))
    of = lambda ws: T.let(sort(ws), lambda es: T.let(heads(es), lambda hs: T.let(ranked(hs, F.size(es)), best)))
    known = lambda keys: F.when(F.size(keys) > 0, T.let(spelled(keys), lambda ws: F.when(F.size(ws) > 0, of(ws))))
    return F.coalesce(T.let(F.array_distinct(F.transform(words, F.lower)), known), none)


def small_capitals_of(text: Column) -> Column:
    """As small_capitals, for one text within its row."""
    words = lambda bs: F.flatten(F.transform(bs, _run))
    done = lambda t, bs: T.let(spellings_of(t, words(bs)), lambda m: F.array_join(F.transform(bs, lambda b: _repaired(b, m)), "\n\n"))
    return T.let(text, lambda t: T.let(_blocks(t), lambda bs: done(t, bs)))


def capital_lines_of(text: Column, headings: Column) -> Column:
    """As capital_lines, for one text within its row; a text without such lines stays as it is."""
    capital = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")
    keys = F.coalesce(F.transform(headings, T.heading_key), F.array().cast("array<string>"))
    repair = lambda ls, m, h: F.array_join(F.transform(ls, lambda x: T.repair_capitals(x, F.array_contains(h, T.heading_key(x)), m)), "\n")
    words = lambda own: F.flatten(F.transform(own, lambda x: F.split(x, " ")))
    done = lambda t, ls, own: F.when(F.size(own) > 0, T.let(spellings_of(t, words(own)), lambda m: T.let(keys, lambda h: repair(ls, m, h)))).otherwise(t)
    return T.let(text, lambda t: T.let(F.split(t, "\n"), lambda ls: T.let(F.filter(ls, capital), lambda own: done(t, ls, own))))


def small_capitals(texts: DataFrame) -> DataFrame:
    """(doc, text) of texts (doc, text), doc unique: paragraphs that begin with two to six words in capitals, before one with a small letter, respelled.

    A word gets its commonest spelling with a small letter in the same text; stop words are lower-cased, and abbreviations, Roman numerals and short words stay. A run
    without a stop word or a word known to the text stays, too. Paragraphs are parted by one blank line afterwards. A null text stays null. Only texts with such runs,
    and of these only the words of the runs, are counted.
    """
    met = _with_map(texts.select("doc", "text"), F.flatten(F.transform(_blocks(F.col("text")), _run)))
    return met.select("doc", F.array_join(F.transform(_blocks(F.col("text")), lambda b: _repaired(b, F.col("m"))), "\n\n").alias("text"))


def capital_lines(texts: DataFrame) -> DataFrame:
    """(doc, text) of texts (doc, text, headings): lines in capitals as titles, if they are among the headings, or as sentences, as the text spells their words. A null text stays null."""
    capital = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")
    words = F.flatten(F.transform(F.filter(F.split("text", "\n"), capital), lambda x: F.split(x, " ")))
    keys = F.transform("headings", T.heading_key)
    met = _with_map(texts.select("doc", "text", F.coalesce(keys, F.array().cast("array<string>")).alias("h")), words)
    return met.select("doc", F.array_join(F.transform(F.split("text", "\n"), lambda x: T.repair_capitals(x, F.array_contains("h", T.heading_key(x)), F.col("m"))), "\n").alias("text"))
