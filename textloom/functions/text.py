"""Text normalisers, predicates and small converters as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION = "\ue000"

# Character classes and word lists.
JAPANESE = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}\x{FF66}-\x{FF9D}"
KANJI = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}"
KANA = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}"
END_MARKS, PAUSE_MARKS, CLOSERS = "。！？!?…", "、，,;；:：", "」』】）)］]〉》”’"
CURLY = ("ʼ‘’“”„‟«»", "'''\"\"\"\"\"\"")
NON_CONTENT = ("表紙", "目次", "contents", "toc", "奥付")
STRUCTURAL = ("prologue", "epilogue", "postscript", "interlude", "preface", "afterword", "まえがき", "前書き", "序章", "プロローグ", "幕間", "間章", "間奏", "エピローグ", "終章", "あとがき", "後書き")
HEADING_HINTS = ("title", "subtitle", "chapter", "section", "headline", "heading", "midashi")
HONORIFICS = ("さん", "くん", "ちゃん", "様", "君", "先生", "先輩")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def straight_quotes(text: Column) -> Column:
    for curly, straight in zip(*CURLY, strict=True):
        text = F.replace(text, F.lit(curly), F.lit(straight))  # looks for bytes, and most texts have none
    return text


def unify_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def where_any(text: Column, parts: list[str], change) -> Column:
    """change(text), if it holds any of the parts, one of which each match of the change has: they are looked for as bytes, without a pattern."""
    return let(text, lambda t: F.when(reduce(or_, (F.contains(t, F.lit(p)) for p in parts)), change(t)).otherwise(t))


def clean(text: Column) -> Column:
    """The text normaliser without section inference: straight quotes, line breaks, blanks, three dots as one run, hyphens at line ends closed up."""
    t = where_any(straight_quotes(text), ["\r"], unify_breaks)
    t = where_any(t, [" \n", "\t\n"], lambda x: F.regexp_replace(x, "[ \t]+\n", "\n"))
    t = where_any(t, ["\n\n\n"], lambda x: F.regexp_replace(x, "\n{3,}", f"\n\n{SECTION}\n\n"))
    t = where_any(t, ["["], lambda x: F.regexp_replace(x, r"(^|[\s“(\"])\[([A-Za-z])\](?=[a-z])", "$1$2"))
    t = where_any(t, ["-\n"], lambda x: F.regexp_replace(x, r"-\n(?=[\p{L}\p{N}_])", "-"))
    t = where_any(t, ["  ", "\t"], lambda x: F.regexp_replace(x, "[ \t]{2,}", " "))
    t = where_any(t, ["..", ". .", ".\t."], lambda x: F.regexp_replace(x, r"\.[ \t]*\.[ \t]*\.", "..."))
    # blanks at an end are looked for where there are any: at the first sign, and at the last one or before a line's end of another kind
    return let(join_dialogue(t), lambda x: F.when(F.substring(x, 1, 1).rlike(r"\s") | F.substring(x, -1, 1).rlike(r"[\s\x{85}\x{2028}\x{2029}]"), strip(x)).otherwise(x))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def join_dialogue(text: Column) -> Column:
    """A block that ends in a pause mark and a following one that opens a quotation stand on successive lines, not in separate blocks."""
    return where_any(text, [f"{x}\n\n" for x in "、，,:： \t"], lambda t: F.regexp_replace(t, r"([、，,:：])[ \t]*\n\n\s*(?=[「『“\"(（])", "$1\n"))


def clean_reader(text: Column) -> Column:
    """The reader's light clean-up: apostrophes, line breaks, blanks; ends in one newline."""
    t = F.translate(text, "ʼ‘’", "'''")
    t = F.regexp_replace(F.regexp_replace(unify_breaks(t), "[ \t]+\n", "\n"), "[ \t]{2,}", " ")
    return F.concat(strip(t), F.lit("\n"))


def heading_key(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def first_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def title_of(text: Column, most: int = 40) -> Column:
    """The first line that isn't blank, cut to `most` characters with dots."""
    line = first_line(text)
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("..."))).otherwise(line)


def markdown_title(text: Column) -> Column:
    line = first_line(text)
    return F.when(line.startswith("#"), F.trim(F.regexp_replace(line, "^#+", ""))).otherwise("")


def filename_title(path: Column) -> Column:
    """A file's name without its suffix and a leading number, dashes and underscores as blanks."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    bare = F.trim(F.translate(F.regexp_replace(stem, "^[0-9]+[-_ ]+", ""), "_-", "  "))
    return F.when(bare != "", bare).otherwise(stem)


def drop_reason(title: Column, patterns: list[str]) -> Column:
    """The first of the patterns found in a title, regardless of case; empty if none is."""
    out = F.lit("")
    for p in reversed(patterns):
        out = F.when(title.rlike(f"(?im){p}"), F.lit(p)).otherwise(out)
    return out


def cutoff(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """The text before the first match of the first pattern that matches at all, and that pattern."""
    cut, why = text, F.lit("")
    for p in reversed(patterns):
        found = text.rlike(f"(?im){p}")
        cut = F.when(found, F.rtrim(F.element_at(F.split(text, f"(?im){p}", 2), 1), F.lit(" \t\r\n"))).otherwise(cut)
        why = F.when(found, F.lit(p)).otherwise(why)
    return cut, why


def remove_all(text: Column, patterns: list[str]) -> tuple[Column, list[Column]]:
    """The text without the matches of patterns, one after the other, and how many of each there were."""
    counts = []
    for p in patterns:
        counts.append(F.regexp_count(text, F.lit(f"(?im){p}")))
        text = F.regexp_replace(text, f"(?im){p}", "")
    return text, counts


def is_symbolic(line: Column) -> Column:
    """A line of symbols only: something visible, no letter, number or mark, and no section mark."""
    bare = F.trim(line)
    return (bare != "") & ~F.contains(bare, F.lit(SECTION)) & ~bare.rlike(r"[\p{L}\p{N}\p{M}]")


def has_bracket(text: Column) -> Column:
    return text.rlike(r"[\p{Ps}\p{Pe}\p{Pi}\p{Pf}]")


def is_note_marker(text: Column) -> Column:
    return F.trim(text).rlike(r"(?i)^\d{1,4}[a-z]?[.)]?$")


def looks_like_filename(title: Column, href: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    name = F.element_at(F.split(F.coalesce(href, F.lit("")), "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return (t == "") | (t == href) | (t == name) | (t == stem) | F.lower(t).rlike(r"\.x?html$") | ((stem != "") & (F.lower(t) == F.lower(stem))) | F.lower(t).rlike(r"^[a-z]\d+[a-z0-9]*$")


def is_non_content(title: Column) -> Column:
    key = heading_key(title)
    return (key == "") | key.isin(*NON_CONTENT)


def is_heading_marker(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike("|".join(HEADING_HINTS)) | low.rlike(r"(^|[-_])(ttl|hd)([-_0-9]|$)")


def is_structural(title: Column) -> Column:
    key = heading_key(title)
    number = "[0-9０-９一二三四五六七八九十百千〇零]+"
    form = rf"^第?{number}[章話部節巻回篇編]|^{number}[.)．、]|^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVXLCDM]+[章話部節巻回篇編.)．、]"
    return (key != "") & (key.isin(*STRUCTURAL) | ((F.length(title) <= 80) & F.trim(title).rlike(form)))


# Where a title page ends and the chapter behind it begins to count, in characters.
TITLE_PAGE_MOST, TITLE_PAGE_NEXT = 80, 400


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def same_heading(a: Column, b: Column) -> Column:
    """Equal but for blanks."""
    one = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return one(a) == one(b)


def is_title_only(title: Column, text: Column) -> Column:
    """A chapter whose only line is its title."""
    lines = lines_of(text)
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    return (F.size(lines) == 1) & (F.length(line) <= TITLE_PAGE_MOST) & same_heading(title, line)


def is_title_inferred(title: Column, text: Column) -> Column:
    """A title that is only the first line of the body."""
    inferred = title_of(text)
    return (inferred != "") & same_heading(title, inferred)


def is_short_structural(title: Column) -> Column:
    number = "[0-9０-９一二三四五六七八九十百千〇零]+"
    bare = F.regexp_replace(title, r"\s+", "")
    return (F.length(title) <= 40) & (F.length(bare) <= 20) & bare.rlike(rf"^(第?{number}[章話部節巻回篇編]?|{number}[.)．、]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[.)．、]?|[IVXLCDM]+[.)．、]?)$")


def absorbs_title_page(title: Column, text: Column, next_title: Column, next_text: Column) -> Column:
    """Whether a chapter is the title page of the next: nothing but its title, before a long body without a title or a numbered heading of its own."""
    first = first_line(next_text)
    return is_title_only(title, text) & (F.length(next_text) >= TITLE_PAGE_NEXT) & is_title_inferred(next_title, next_text) & ~same_heading(title, first) & ~is_short_structural(first)


def continues_chapter(headings: Column, text: Column) -> Column:
    """A page without a structural heading at its head or among its headings goes on with the chapter before it; so does an empty one."""
    return ~F.exists(headings, lambda h: is_structural(h)) & ((F.trim(text) == "") | ~is_structural(first_line(text)))


def is_fragment(title: Column, href: Column, headings: Column, text: Column) -> Column:
    """A page that starts no chapter: its title is a file's name, or it has no heading and its title is its first line, which is not a structural one."""
    return looks_like_filename(title, href) | ((F.size(headings) == 0) & is_title_inferred(title, text) & ~is_structural(title))


def gap_has_separator(gap: Column) -> Column:
    """A gap between chunks with a line that holds a section mark, or no letter and no number."""
    return F.exists(F.split(gap, "\n"), lambda x: (F.trim(x) != "") & (F.contains(x, F.lit(SECTION)) | ~x.rlike(r"[\p{L}\p{N}]")))


#: Signs that are looked through at the end of a chunk, and those that end a sentence.
CHUNK_CLOSERS, CHUNK_ENDS = "」』）】］〉》”’\"'", "。！？!?…"


def ends_open(text: Column) -> Column:
    """A text whose last sign, behind closing brackets and quotes, is a pause mark, a dash or an ellipsis."""
    return text.rlike(f"[{PAUSE_MARKS}—―─━…⋯][{CHUNK_CLOSERS}]*$")


def is_continuation_gap(before: Column, gap: Column) -> Column:
    """A line break within a sentence: no section mark and no separator in it, and the chunk before it ends open."""
    return F.contains(gap, F.lit("\n")) & ~F.contains(gap, F.lit(SECTION)) & ends_open(before) & ~gap_has_separator(gap)


def is_paragraph_gap(gap: Column) -> Column:
    return F.contains(gap, F.lit("\n")) | F.contains(gap, F.lit(SECTION))


def is_hard_boundary(before: Column, gap: Column) -> Column:
    """A gap that chunks are not joined across: another line, or blanks behind what is no end of a sentence."""
    return is_paragraph_gap(gap) | ((gap != "") & (F.trim(gap) == "") & ~before.rlike(f"[{CHUNK_ENDS}][{CHUNK_CLOSERS}]*$"))


#: Pauses behind a chunk, as multiples of the shortest.
SECTION_PAUSE, TITLE_PAUSE = 3, 5


def gap_pause(gap: Column) -> Column:
    return F.when(F.contains(gap, F.lit(SECTION)), SECTION_PAUSE).when(gap.rlike("\n{5}"), TITLE_PAUSE).when(gap.rlike("\n{3}"), SECTION_PAUSE).otherwise(1)


def is_all_caps(word: Column) -> Column:
    return word.rlike(r"\p{L}") & ~word.rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_suspicious(base: Column, reading: Column) -> Column:
    """A ruby span that can't be right: blank, kanji in the reading, a line or section break, or a reading far too long."""
    bad = f"[\n{SECTION}]"
    return (F.trim(base) == "") | (F.trim(reading) == "") | reading.rlike(f"[{KANJI}]") | base.rlike(bad) | reading.rlike(bad) | (F.length(reading) > F.greatest(F.lit(24), 6 * F.length(base)))


def has_honorific(text: Column, base: str) -> Column:
    return text.rlike(rf"\Q{base}\E(?:{'|'.join(HONORIFICS)})")


def script(text: Column) -> Column:
    """kanji, hiragana, katakana, kana (both), mixed, or other, by the characters that a text is made of."""
    return (
        F.when(text.rlike(f"^[{KANJI}]+$"), "kanji").when(text.rlike(r"^[\x{3040}-\x{309F}]+$"), "hiragana").when(text.rlike(r"^[\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}]+$"), "katakana")
        .when(text.rlike(f"^[{KANA}]+$"), "kana").when(text.rlike(f"[{JAPANESE}]"), "mixed").otherwise("other")
    )


_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))


def to_hiragana_map() -> dict[int, int]:
    """For str.translate."""
    return str.maketrans(_KATAKANA, _HIRAGANA)


def to_hiragana(text: Column) -> Column:
    return F.translate(text, _KATAKANA, _HIRAGANA)


def to_katakana(text: Column) -> Column:
    return F.translate(text, _HIRAGANA, _KATAKANA)


def without_double_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r"[\"\x{AB}\x{BB}\x{201C}-\x{201F}\x{301D}-\x{301F}\x{FF02}]", "")


# Japanese quotation marks, single ones, runs of dashes, and words that begin with an apostrophe.
#: Signs that are no quotation mark, dash, wave, ellipsis or format character: the rules about these pass over texts of nothing else.
PLAIN = r"\n\x{20}\x{21}\x{23}-\x{26}\x{28}-\x{7D}\x{C0}-\x{17F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{3001}\x{3002}"
JAPANESE_QUOTES, SINGLE_QUOTES, DASHES = "「」『』《》〈〉【】〔〕［］｢｣〝〞〟", "'‘’‚‛＇", "‐‑‒–—―─━"
ELISIONS = ("tis", "twas", "twere", "twill", "til", "em", "cause", "bout", "round")


def _where(text: Column, signs: str, change) -> Column:
    """change(text), if it has any of the signs that the change is about."""
    return let(text, lambda t: F.when(t.rlike(f"[{signs}]"), change(t)).otherwise(t))


def without_japanese_quotes(text: Column) -> Column:
    """Without Japanese quotation marks; a comma stands where one closes between two Japanese signs."""
    return _where(text, r"\x{3008}-\x{3011}\x{3014}\x{3015}\x{301D}-\x{301F}\x{FF3B}\x{FF3D}\x{FF62}\x{FF63}", _without_japanese_quotes)


def _without_japanese_quotes(text: Column) -> Column:
    quotes, closing = JAPANESE_QUOTES.replace("]", r"\]"), "」』》〉】〕］｣〟"
    return F.regexp_replace(F.regexp_replace(text, f"(?=[{closing}])(?<=[{JAPANESE}])[{closing}](?=[{quotes}]*[{JAPANESE}])", "、"), f"[{quotes}]", "")


def without_single_quotes(text: Column) -> Column:
    """Without single quotes but for apostrophes: between ASCII letters or digits, between Japanese signs, and before words that lack their beginning."""
    q = r"['\x{2018}-\x{201B}\x{FF07}]"  # SINGLE_QUOTES
    keep = (f"(?<=[A-Za-z0-9]){q}(?=[A-Za-z0-9])", f"(?<=[{JAPANESE}]){q}(?=[{JAPANESE}])", rf"(?<![\p{{L}}\p{{N}}]){q}(?=(?i:{'|'.join(ELISIONS)})(?![A-Za-z]))")
    return F.regexp_replace(text, f"(?={q})" + "".join(f"(?!{k})" for k in keep) + q, "")  # what surrounds a sign is looked at where there is one


def _ends_with(text: Column, marks: str, closers: str) -> Column:
    """Whether one of the marks stands at a text's end, behind closers. Its last signs tell, unless they are closers all."""
    found, last = f"[{marks}][{closers}]*$", F.substring(text, -16, 16)
    return last.rlike(found) | (F.length(text) > 16) & last.rlike(f"^[{closers}]*$") & text.rlike(found)


def final_stop(text: Column) -> Column:
    """A full stop behind a Japanese text whose last line lacks a mark; brackets at its end are looked through."""
    bare = F.rtrim(text)
    marked = bare.endswith("・") | _ends_with(bare, END_MARKS + PAUSE_MARKS, CHUNK_CLOSERS)
    return F.when(text.rlike(f"[{JAPANESE}]") & (bare != "") & ~marked, F.concat(text, F.lit("。"))).otherwise(text)


def without_format_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cf}", "")


def tail_stop(text: Column) -> Column:
    """A full stop behind every line of a Japanese text that lacks a mark there; closing brackets are looked through."""
    marks = END_MARKS + PAUSE_MARKS
    closers = CLOSERS.replace("]", r"\]")
    stopped = lambda x, bare: F.when((bare == "") | bare.endswith("・") | _ends_with(bare, marks, closers), x).otherwise(F.concat(bare, F.lit("。"), F.substring(x, F.length(bare) + 1, F.length(x))))
    one = lambda x: let(F.rtrim(x), lambda bare: stopped(x, bare))
    lines = F.when(F.contains(text, F.lit("\n")), F.array_join(F.transform(F.split(text, "\n"), one), "\n")).otherwise(one(text))
    return F.when(text.rlike(f"[{JAPANESE}]"), lines).otherwise(text)


def space_to_pause(text: Column, full_stop: bool = True) -> Column:
    """Blanks between Japanese characters as pauses: a full stop if there is one such blank and no mark or ASCII letter or digit, else commas."""
    between = f"(?= )(?<=[{JAPANESE}]) (?=[{JAPANESE}])"  # the blank is looked for first, as it is rarer
    alone = (F.regexp_count(text, F.lit(between)) == 1) & ~text.rlike(f"[{END_MARKS}{PAUSE_MARKS}A-Za-z0-9]") & F.lit(full_stop)
    return F.when(alone, F.regexp_replace(text, between, "。")).otherwise(F.regexp_replace(text, between, "、"))


def wave_dashes(text: Column) -> Column:
    """Wave dashes: a range word between numbers, a long vowel at kana, a comma between blanks, else nothing."""
    return _where(text, "~～〜", _wave_dashes)


def _wave_dashes(text: Column) -> Column:
    number = "0-9０-９一二三四五六七八九十百千万億兆京〇零"
    t = F.regexp_replace(text, "[~～〜]+", "~")
    t = F.regexp_replace(t, rf"(?=[\s~])(?<=[{JAPANESE}])(?:\s+~\s*|~\s+)(?=[{JAPANESE}])", "、")
    t = F.regexp_replace(t, r"(?<=\s)~|~(?=\s)", "")
    t = F.regexp_replace(t, f"(?=~)(?<=[{number}])~(?=[{number}])", "から")
    t = F.regexp_replace(t, f"(?=~)(?:(?<=[{KANA}])~(?=[{JAPANESE}])|(?<=[{JAPANESE}])~(?=[{KANA}]))", "ー")
    closers = CLOSERS.replace("]", r"\]")
    t = F.regexp_replace(t, f"(?=~)(?<=[{JAPANESE}])~(?=$|[{END_MARKS}{PAUSE_MARKS}{closers}])", "ー")
    return F.replace(F.regexp_replace(t, f"(?=~)(?<=[{JAPANESE}])~(?=[{JAPANESE}])", "、"), F.lit("~"), F.lit(""))


def short_ellipsis(text: Column) -> Column:
    return F.regexp_replace(text, "[…⋯]{3,}", "⋯")


def ellipsis_pause(text: Column, base: int = 380, step: int = 120, most: int = 1200) -> Column:
    """Milliseconds of silence for a text of nothing but ellipses, 0 for any other."""
    bare = F.regexp_replace(text, "[\\s\"'“”‘’「」『』]", "")
    n = F.length(bare)
    return F.when(bare.rlike("^[…⋯]+$"), F.greatest(F.lit(base), F.least(F.lit(most), F.lit(base) + (n - 1) * step))).otherwise(0)


def authors(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[,\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def metadata_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\=;#\n])", r"\\$1")


def chapter_id(index: Column, title: Column) -> Column:
    """NNNN-slug from the ASCII letters and digits of a title; `chapter` if it has none."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.concat(F.lpad(index.cast("string"), 4, "0"), F.lit("-"), F.when(slug != "", slug).otherwise("chapter"))


def path_safe(title: Column, most: int = 80) -> Column:
    """A title as a folder's name: no separators, reserved or invisible characters, no dots at the ends."""
    t = F.regexp_replace(F.translate(F.coalesce(title, F.lit("")), "/\\:*?\"<>|", " " * 9), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}]", "")
    t = F.regexp_replace(strip(F.regexp_replace(t, r"[\s\p{Zs}]+", " ")), r"^\.+|\.+$", "")
    return F.when(F.length(t) > most, F.rtrim(F.substring(t, 1, most))).otherwise(t)


def is_http_url(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^https?://[^\s/]+")


# Words that stay small inside a repaired line, and abbreviations that stay capital.
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def repair_capitals(line: Column, heading: Column, spellings: Column) -> Column:
    """A line in capitals as a title (headings) or a sentence; other lines stay.

    spellings: a map from lower-case words to how they are spelled elsewhere. Small words are lower-cased, Roman numerals and
    words of up to three letters stay as they are.
    """
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        known = F.try_element_at(spellings, low)
        first = lambda x: F.when(i == 0, F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))).otherwise(x)
        plain = F.when(heading | (i == 0), title(w)).otherwise(low)
        keep = w.rlike("^[IVXLCDM]+$") | (F.length(w) <= 3)
        return F.when(known.isNotNull(), first(known)).when(low.isin(*SMALL_WORDS), F.when(i == 0, title(w)).otherwise(low)).when(keep, w).otherwise(plain)

    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    return F.when(capitals, F.array_join(F.transform(F.split(line, " "), word), " ")).otherwise(line)


def css_markers(css: Column) -> Column:
    """Class and id names (with their sign) of a style sheet's selectors that look like headings, each once, in order of appearance."""
    selectors = F.regexp_extract_all(F.regexp_replace(css, r"(?s)/\*.*?\*/", ""), F.lit(r"([^{}]+)\{"), F.lit(1))
    names = F.flatten(F.transform(selectors, lambda s: F.regexp_extract_all(s, F.lit(r"([.#][A-Za-z_][\w-]*)"), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.lower(n)), lambda n: is_heading_marker(F.substring(n, F.lit(2), F.length(n)))))
