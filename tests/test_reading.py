"""What chunks are read as, against brute force and planted cases."""

import hashlib
import re
import sys
import unicodedata
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

import regex
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import preparation as P
from textloom.plans import reading
from textloom.plans.books import LATIN, SIGNS

JA = re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{m[1]:0>8}", T.JAPANESE)
KANA = re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{m[1]:0>8}", T.KANA)
MARKS, CLOSERS = re.escape(T.END_MARKS + T.PAUSE_MARKS), re.escape(T.CHUNK_CLOSERS)


def japanese(c):
    return bool(c) and bool(re.match(f"[{JA}]", c))


def needs_stop(line):
    return bool(line) and line[-1] != "・" and not re.search(f"[{MARKS}][{re.escape(T.CLOSERS)}]*$", line)


def prepare(t, stops=False, old="", new=""):
    t = "".join(p if p[:1] in "…⋯" else unicodedata.normalize("NFKC", p) for p in re.split("([…⋯]+)", t) if p).translate(str.maketrans(old, new))
    dashed = bool(re.search("[‐‑‒–—―─━]{2,}", t))
    t = re.sub("[‐‑‒–—―─━]{2,}", " ", t)
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    if stops and any(map(japanese, t)):
        t = "\n".join(x.rstrip(" ") + "。" + x[len(x.rstrip(" ")) :] if needs_stop(x.rstrip(" ")) else x for x in t.split("\n"))
    out = []
    for i, c in enumerate(t):  # sign by sign
        if c in T.JAPANESE_QUOTES:
            j = i + 1
            while j < len(t) and t[j] in T.JAPANESE_QUOTES:
                j += 1
            if c in "」』》〉】〕］｣〟" and i and japanese(t[i - 1]) and j < len(t) and japanese(t[j]):
                out.append("、")
        else:
            out.append(c)
    t = "".join(c for c in out if c not in "\"“”„‟«»＂〝〞〟")
    out = []
    for i, c in enumerate(t):
        if c in T.SINGLE_QUOTES:
            a, b = t[i - 1 : i] if i else "", t[i + 1 : i + 2]
            word = re.match("[A-Za-z]*", t[i + 1 :])[0].lower()
            if not (re.match("[A-Za-z0-9]", a or " ") and re.match("[A-Za-z0-9]", b or " ") or japanese(a) and japanese(b) or not (a and a.isalnum()) and word in T.ELISIONS):
                continue
        out.append(c)
    t = re.sub("[…⋯]{3,}", "⋯", "".join(out))
    t = re.sub("[~～〜]+", "~", t)
    number = "0-9０-９一二三四五六七八九十百千万億兆京〇零"
    t = regex.sub(rf"(?<=[{JA}])(?:\s+~\s*|~\s+)(?=[{JA}])", "、", t)
    t = re.sub(r"(?<=\s)~|~(?=\s)", "", t)
    t = re.sub(f"(?<=[{number}])~(?=[{number}])", "から", t)
    t = re.sub(f"(?<=[{KANA}])~(?=[{JA}])|(?<=[{JA}])~(?=[{KANA}])", "ー", t)
    t = re.sub(f"(?<=[{JA}])~(?=$|[{MARKS}{re.escape(T.CLOSERS)}])", "ー", t)
    t = re.sub(f"(?<=[{JA}])~(?=[{JA}])", "、", t).replace("~", "")
    t = re.sub(r"\s+", " ", t).strip()
    between = f"(?<=[{JA}]) (?=[{JA}])"
    alone = len(re.findall(between, t)) == 1 and not re.search(f"[{MARKS}A-Za-z0-9]", t) and not dashed
    t = re.sub(between, "。" if alone else "、", t)
    if stops and any(map(japanese, t)) and t.rstrip() and t.rstrip()[-1] != "・" and not re.search(f"[{MARKS}][{CLOSERS}]*$", t.rstrip()):
        t += "。"
    return t


def test_prepared_lines(spark, sf):
    signs, marks = str.maketrans(LATIN, SIGNS), str.maketrans(reading._FROM, reading._TO)
    want = {}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for i, line in enumerate(r.text.lower().translate(signs).split("\n")):
            t = line.translate(marks).replace("、 ", "〜")
            want[r.doc_id, i] = md5(prepare(t)), md5(prepare(t, True, "阪", "坂"))
    assert {(r.doc_id, r.i): (r.h, r.stops) for r in reading.QUERIES["f29_prepared"](spark, sf).collect()} == want


def test_prepare_cases(spark):
    cases = ["…………", "あ……い", "「漢字」と『かな』", "「あ」い", "rock 'n' roll, don't 'tis", "東京――大阪", "東京 大阪", "東京 大阪 京都", "ｶﾅ①", "", None, "行く。」\n来る", "a\u200bb", "「」", "10〜20人と〜", "終わり・", "（はい）"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", P.prepare(F.col("t")).alias("plain"), P.prepare(F.col("t"), short_stops=True).alias("stops")).orderBy("i").collect()
    assert [(r.plain, r.stops) for r in rows] == [(prepare(t or ""), prepare(t or "", True)) for t in cases]
    got = {cases[r.i]: (r.plain, r.stops) for r in rows}
    assert got["…………"] == ("⋯", "⋯") and got["あ……い"][0] == "あ……い" and got["東京 大阪"][0] == "東京。大阪" and got["東京――大阪"][0] == "東京、大阪" and got["「あ」い"][0] == "あ、い"
    assert got["rock 'n' roll, don't 'tis"][0] == "rock n roll, don't 'tis"


def test_pipeline_order(spark):
    chunks = spark.createDataFrame([("b", 1, 0, 0, 6, "漢字3個東だ"), ("b", 1, 1, 7, 11, "木木東木"), ("c", 2, 0, 0, 2, "木木"), ("b", 1, 2, 12, 12, None)], "book string, chapter long, chunk int, start long, end long, text string")
    spans = spark.createDataFrame([(1, 0, 1, "漢", "カン"), (1, 1, 2, "字", "じ"), (1, 4, 5, "東", "漢"), (1, 6, 8, "x", "y"), (1, 10, 11, "東", "ずれ")], "chapter long, start long, end long, base string, reading string")
    entry = "book string, ord int, base string, pattern string, reading string, mode string"
    book = spark.createDataFrame([("b", 0, "木木", None, "モリ", None), ("b", 1, " 東 ", None, "ひがし", None)], entry)
    own = spark.createDataFrame([("b", 0, "東", None, "トウ", None)], entry)
    got = {(r.chapter, r.chunk): r for r in P.pipeline(chunks, spans, book, own).collect()}
    # the two one-kanji spans are one reading in both scripts, so it becomes hiragana; the override's base is left to the override
    assert got[1, 0].ruby_text == "かんじ3個東だ" and got[1, 0].after_overrides == "かんじ3個トウだ" and got[1, 0].prepared == "かんじさんこトウだ。"
    assert got[1, 1].ruby_text == "モリ東木" and got[1, 1].after_overrides == "モリトウ木" and got[2, 0].ruby_text == "木木"
    assert got[1, 2].ruby_text is None and got[1, 2].prepared == ""


def test_dates_before_weekdays(spark):
    from textloom.functions.spoken import speak

    for day in ("(月)", "(月曜)", "(月曜日)", "（土曜）", " (月)"):
        assert speak(f"5/3{day}").startswith("ごがつみっか"), day
    assert speak("5/3(x)").startswith("さんぶんのご")
