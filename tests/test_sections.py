"""Section marks, override files and folders, against brute force and planted cases."""

import collections
import hashlib
import json
import random
import re
import sys
import unicodedata
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import casing, dictionary, sections
from textloom.operators import overrides as O
from textloom.plans import text as plans

S = T.SECTION


def marked(text):
    """The same, line by line."""
    if text is None:
        return None
    lines = [x.strip() for x in text.split("\n")]
    symbolic = [bool(x) and S not in x and not any(unicodedata.category(c)[0] in "LNM" for c in x) for x in lines]
    count, alone, other = collections.Counter(), collections.Counter(), collections.Counter()
    for x, s in zip(lines, symbolic, strict=True):
        if s:
            count[x] += 1
        else:
            other.update(c for c in x if not c.isspace())
    i = 0
    while i < len(lines):
        j = i + 1
        if symbolic[i]:
            while j < len(lines) and lines[j] == lines[i]:
                j += 1
            if (i == 0 or not lines[i - 1]) and (j == len(lines) or not lines[j]):
                alone[lines[i]] += j - i
        i = j
    good = set()
    for m, n in count.items():
        signs = [c for c in m if not c.isspace()]
        inside = sum(other[c] for c in signs)
        if any(unicodedata.category(c) in ("Ps", "Pe", "Pi", "Pf") for c in m) or inside > 0.35 * n * len(signs):
            continue
        if (n >= 2 and alone[m] >= 0.8 * n) or (n == 1 and len(signs) == 1 and inside == 0):
            good.add(m)
    t = "\n".join(S if x.strip() in good else x for x in text.split("\n"))
    if S in t:
        t = re.sub("\n{3,}", "\n\n", re.sub(f"[ \t]*{S}[ \t]*", f"\n\n{S}\n\n", t))
        t = re.sub(f"(?:{S}\n\n){{2,}}", f"{S}\n\n", re.sub(f"(?:\n\n{S}){{2,}}", f"\n\n{S}", t))
        t = re.sub(rf"(?:\s*{S}\s*)+$", "", re.sub(rf"^(?:\s*{S}\s*)+", "", t))
    return t


def test_sections(spark, sf):
    texts = {r.doc: r.text for r in plans.sections_of(spark, sf).collect()}
    got = {r.doc_id: (r.h, r.n) for r in plans.QUERIES["f4_sections"](spark, sf).collect()}
    want = {i: marked(t) for i, t in texts.items()}
    assert got == {i: (hashlib.md5(t.encode()).hexdigest(), t.count(S)) for i, t in want.items()}
    assert sum(n for _, n in got.values()) > 100


def test_section_cases(spark):
    cases = [None, "", "***", "a\n\n***\n\nb", "a\n\n†\n\nb", "†\n\na\n\n†", "a\n***\nb\n\n***\n\nc", "x\n\n*\n*\n\ny", "(*)\n\na\n\n(*)", f"{S}a{S}{S}b \t{S} ", "-\n\na-b\n\n-", "# #\n\na\n\n# #\n\nb"]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc int, text string")
    assert {r.doc: r.text for r in sections.with_sections(rows).collect()} == {i: marked(t) for i, t in enumerate(cases)}
    got = sections.normalise(spark.createDataFrame([(1, "a  b\r\n\r\n***\r\n\r\nc\n\n\n\nd\n\n***\n\ne")], "doc int, text string")).first().text
    assert got == f"a b\n\n{S}\n\nc\n\n{S}\n\nd\n\n{S}\n\ne"


def test_rules_learn_of_a_text_within_its_row(spark):
    """The same as over tables, of texts that each rule has something to do with."""
    rng = random.Random(4)
    signs = ["", "", "", " ", "***", " *** ", "*", "†", "# #", "a*", "x", "Word of THE", S, f" {S}", "(*)", "-", "\u00a0", "*\u2028 ", "\U0001f600", "- \U0001f600"]
    words = ["THE", "OLD", "House", "HOUSE", "house", "hOuse", "Old", "old", "the", "IV", "o'Neil", "O'NEIL", "ÄRA", "ära", "1", "and", "AND", "\n\n", "\n\n", "\n", ".", "x"]
    texts = [None, "", *("\n".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(400)), *(" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(400))]
    rows = spark.createDataFrame([(i, t, [["THE OLD  HOUSE"], [], None][i % 3]) for i, t in enumerate(texts)], "doc int, text string, headings array<string>")
    own = rows.select("doc", sections.sectioned(F.col("text")), casing.small_capitals_of(F.col("text")), casing.capital_lines_of(F.col("text"), F.col("headings")))
    got = {r[0]: tuple(r)[1:] for r in own.collect()}
    tables = [{r.doc: r.text for r in f(rows).collect()} for f in (sections.with_sections, casing.small_capitals, casing.capital_lines)]
    assert got == {i: tuple(t[i] for t in tables) for i in range(len(texts))}
    assert all(sum(t[i] != x for i, x in enumerate(texts)) > 50 for t in tables)


def test_clean_texts_are_looked_at_for_bytes(spark):
    """The guards of the steps change nothing: the steps without them, one after the other."""
    rng = random.Random(6)
    parts = ["a", "B ", " ", "\t", "\n", "\n\n", "\r", "\r\n", "[", "[A]b", "-\n", ".", ". .", "...", "、", ",\n\n", "「", "“", "(", "\u2028", "\u0085", "’", "«", "漢"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000))]
    t = F.regexp_replace(F.translate("t", *T.CURLY), "\r\n?", "\n")
    rules = [("[ \t]+\n", "\n"), ("\n{3,}", f"\n\n{S}\n\n"), (r"(^|[\s“(\"])\[([A-Za-z])\](?=[a-z])", "$1$2"), (r"-\n(?=[\p{L}\p{N}_])", "-"), ("[ \t]{2,}", " "), (r"\.[ \t]*\.[ \t]*\.", "..."), (r"([、，,:：])[ \t]*\n\n\s*(?=[「『“\"(（])", "$1\n"), (r"^\s+|\s+$", "")]
    for pattern, new in rules:
        t = F.regexp_replace(t, pattern, new)
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.clean(F.col("t")).alias("got"), t.alias("want")).collect()
    assert all(r.got == r.want for r in got) and len(got) == len(texts)


def test_chapters_meet_their_spans_once(spark):
    """Versions of a chapter are cleaned within its row: one join, no window, and no row for a span and its text."""
    from textloom.operators import sanitise, tracking

    chapters = spark.createDataFrame([(i, f"THE OLD cat {i} 12345 sat\n\n†\n\nold The", ["x"]) for i in range(9)], "chapter long, text string, headings array<string>")
    spans = spark.createDataFrame([(i, 8, 11, "cat", "ねこ") for i in range(9)], "chapter long, start int, end int, base string, reading string")
    got = tracking.tracked(chapters, spans, tracking.by_rows(*sanitise.steps(sanitise.Rules(remove=[r"\d{4,} "]), F.col("headings"))))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan
    assert {(r.cleaned, r.tracked, tuple(r.spans[0])) for r in got.collect()} == {(f"The old cat {i} sat\n\n{S}\n\nold The", True, (8, 11, "cat", "ねこ")) for i in range(9)}


def test_override_files(spark):
    files = {
        "a": {"global": [["木", "き"], {"base": "大阪", "reading": " おおさか ", "scope": "once"}, ["x"], {"base": "y"}], "default": [["z", "zz"]], "chapters": {"1": {"entries": [{"pattern": "a+", "kana": "え"}]}, "2": {"replacements": [], "entries": [["re:b", "c"]]}, "3": 5}},
        "b": {"global": [], "*": {"replacements": [{"base": "字", "reading": "じ", "mode": None}]}}, "c": {"c1": [["林", "はやし"], ["ab", "c"]], "c2": "no"}, "d": {"default": [{"base": "q.", "regex": True, "reading": "r"}], "9": [["n", "m"]]}, "e": [["list", "at top"]],
    }
    rows = [(k, json.dumps(x)) for k, x in files.items()] + [("f", "{broken"), ("g", None), ("h", "")]
    got = sorted((r.book, r.chapter or "", r.ord, r.base, r.pattern, r.reading, r.mode) for r in O.book_overrides(spark.createDataFrame(rows, "book string, data string")).collect())
    assert got == [
        ("a", "", 0, "木", None, "き", "isolated"), ("a", "", 1, "大阪", None, "おおさか", "first"), ("a", "1", 0, None, "a+", "え", None), ("a", "2", 0, None, "b", "c", None), ("b", "", 0, "字", None, "じ", None),
        ("c", "c1", 0, "林", None, "はやし", "isolated"), ("c", "c1", 1, "ab", None, "c", None), ("d", "", 0, None, "q.", "r", None),
    ]


def test_folders(spark):
    rows = [(1, "a/b: c?"), (2, "a b c"), (3, None), (4, "  "), (5, "..x.."), (6, "long " * 40), (7, "a\u200bb\x07")]
    got = {r.book: r.folder for r in dictionary.unique_folders(spark.createDataFrame(rows, "book int, title string")).collect()}
    assert got == {1: "a b c", 2: "a b c-2", 3: "book", 4: "book-2", 5: "x", 6: ("long " * 16).rstrip(), 7: "ab"}


def test_sanitise(spark):
    from textloom.operators import sanitise

    text = "THE OLD HOUSE stood  there. 12345 It was 漢字 here.\n\n***\n\nCHAPTER ONE OF IT\n\nOne old house, one House, a house.\n\n***\n\nThe end.\nAll rights reserved\nmore"
    chapters = spark.createDataFrame([(1, "One", text, ["Chapter one of it"]), (2, "Contents of it", "x", None), (3, None, None, None), (4, "Four", "", [])], "chapter long, title string, text string, headings array<string>")
    at = text.index("漢字")
    spans = spark.createDataFrame([(1, at, at + 2, "漢字", "かんじ"), (1, text.index("HOUSE"), text.index("HOUSE") + 5, "HOUSE", "いえ"), (1, text.index("more"), text.index("more") + 4, "more", "もあ"), (2, 0, 1, "x", "y")], "chapter long, start int, end int, base string, reading string")
    rules = sanitise.Rules(drop=["^contents"], cutoff=["^all rights reserved"], remove=[r"\d+ "])
    texts, found = sanitise.sanitise(chapters, spans, rules)
    got = {r.chapter: r for r in texts.collect()}
    clean = f"The old house stood there. It was 漢字 here.\n\n{S}\n\nChapter One of It\n\nOne old house, one House, a house.\n\n{S}\n\nThe end."
    assert got[1].text == clean and got[1].why == "^all rights reserved" and got[1].raw_chars == len(text) and got[1].clean_chars == len(clean)
    assert got[2].reason == "^contents" and got[2].text is None and got[3].text == "" and got[4].clean_chars == 0
    spots = sorted((r.chapter, clean[r.start : r.end], r.reading) for r in found.collect())
    assert spots == [(1, "house", "いえ"), (1, "漢字", "かんじ")]


def test_sanitised_documents(spark, sf):
    """Spans stand where their base stands in the clean text, whichever way they came."""
    from textloom.operators import sanitise
    from textloom.plans import books

    rows = books.QUERIES["f11_sanitised"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and {r.how for r in rows} >= {"tracked"}
    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS chapter", "'' AS title", "text", "array() AS headings")
    words = books._words(d, "chapter").filter("i % 5 = 0 AND length(w) > 2").selectExpr("chapter", "start", "start + length(w) AS end", "w AS base", "concat('ん', lower(w)) AS reading")
    texts, found = sanitise.sanitise(d, words, books.RULES)
    clean = {r.chapter: r.text for r in texts.collect()}
    spans = found.collect()
    assert spans and all(clean[r.chapter][r.start : r.end].lower() == r.base.lower() for r in spans)
    assert sum(r.how == "tracked" for r in spans) > 0.5 * len(spans)
