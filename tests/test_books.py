"""Chapters of books, tracked spans, differences, sinks and upserts: brute force over the smallest tables, planted cases, broken runs."""

import collections
import difflib
import json
import random
import re
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from pyspark.sql import functions as F

from textloom import sinks
from textloom.functions import alignment as A
from textloom.functions import html as H
from textloom.functions import text as T
from textloom.operators import casing, chapters, tracking
from textloom.operators import spans as S
from textloom.plans import books
from textloom.streaming import boundary

SPAN = "chapter long, start int, end int, base string, reading string"


# ---- tracked spans


def origins(text, rules):
    """Rewriting with the place each sign comes from: (pattern, replacement with groups)."""
    signs = [(c, i) for i, c in enumerate(text)]
    for pattern, repl in rules:
        out, at = [], 0
        joined = "".join(c for c, _ in signs)
        for m in re.finditer(pattern, joined):
            out += signs[at : m.start()]
            for piece in re.split(r"(\\\d)", repl):
                out += signs[slice(*m.span(int(piece[1])))] if re.fullmatch(r"\\\d", piece) else [(c, None) for c in piece]
            at = m.end()
        signs = out + signs[at:]
    return signs


def cleaned(text):
    text = text.translate(str.maketrans(*T.CURLY))
    rules = [(r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", f"\n\n{T.SECTION}\n\n"), (r'(^|[\s“("])\[([A-Za-z])\](?=[a-z])', r"\1\2"), (r"-\n(?=\w)", "-"), (r"[ \t]{2,}", " "), (r"\.[ \t]*\.[ \t]*\.", "..."), (r'([、，,:：])[ \t]*\n\n\s*(?=[「『“"(（])', "\\1\n"), (r"^\s+|\s+$(?!\n)", "")]
    return origins(text, rules + [(f"(?im){p}", "") for p in books.REMOVE])


def test_tracked(spark, sf):
    texts, spans, clean = books.tracked_of(spark, sf, books.REMOVE)
    plain = {r.chapter: r.text for r in texts.collect()}
    given = collections.defaultdict(list)
    for r in spans.collect():
        given[r.chapter].append((r.start, r.end, r.base, r.reading))
    followed = 0
    for row in tracking.tracked(texts, spans, clean).collect():
        signs = cleaned(plain[row.chapter])
        assert row.cleaned == "".join(c for c, _ in signs)
        if not row.tracked:
            assert row.spans is None
            continue
        followed += 1
        place = {i: k for k, (_, i) in enumerate(signs) if i is not None}
        want = []
        for a, b, _, reading in sorted(given[row.chapter]):
            kept = [place[i] for i in range(a, b) if i in place]
            base = "".join(signs[k][0] for k in kept)
            said = re.sub(r"(?im)\d+|the ", "", reading)
            if kept and not re.search(f"[\n{T.SECTION}]", base) and len(said) <= max(24, 6 * len(base)):
                want.append((min(kept), max(kept) + 1, base, said))
        assert [tuple(x) for x in row.spans] == want
    assert followed > 0.4 * len(plain)  # the others have a marker within what a rule looks for, as in `the `


def test_tracked_rows(spark):
    texts = spark.createDataFrame([(1, "  ab  漢字 cd"), (2, "x " + A.OPEN + " 漢字"), (3, None), (4, "漢  \n字だ"), (5, ""), (6, "12 漢字34 ")], "chapter long, text string")
    spans = spark.createDataFrame([(1, 6, 8, "漢字", "かんじ"), (1, 7, 8, "字", "じ"), (1, 0, 99, "", "x"), (1, 2, 4, "zz", "x"), (2, 4, 6, "漢字", "かんじ"), (3, 0, 1, "a", "b"), (4, 0, 1, "漢", "かん"), (6, 3, 5, "", "かんじ"), (1, 9, 10, "c", "漢")], SPAN)
    got = {r.chapter: r for r in tracking.tracked(texts, spans, tracking.by_rows(T.clean)).collect()}
    assert got[1].tracked and [tuple(x) for x in got[1].spans] == [(3, 5, "漢字", "かんじ")] and got[1].spoken == "ab かんじ 漢d"
    assert not got[2].tracked and got[2].spans is None
    assert got[3].cleaned == "" and got[3].spans == [] and got[5].spans == []
    assert got[4].cleaned == "漢\n字だ" and got[4].tracked and [tuple(x) for x in got[4].spans] == [(0, 1, "漢", "かん")]
    # a rule on digits doesn't meet the markers' numbers; one that eats a base's surroundings leaves its place right
    found = tracking.clean_spans(texts, spans, tracking.by_rows(lambda t: F.regexp_replace(t, r"\d", ""))).filter("chapter = 6").collect()
    assert [(r.start, r.end, r.base, r.reading, r.how) for r in found] == [(1, 3, "漢字", "かんじ", "tracked")]
    # a rule that needs the signs next to each other is blocked by a marker: the difference takes over
    one = spark.createDataFrame([(1, "ab 漢字 cd")], "chapter long, text string"), spark.createDataFrame([(1, 3, 5, "漢字", "かんじ")], SPAN)
    found = tracking.clean_spans(*one, tracking.by_rows(lambda t: F.regexp_replace(t, "字 c", "字c"))).collect()
    assert [(r.start, r.end, r.base, r.reading.strip(), r.how) for r in found] == [(3, 5, "漢字", "かんじ", "difference")]


def differences(plain, ruby):
    out = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, plain, ruby, autojunk=False).get_opcodes():
        if tag == "replace":
            out += A.split_on_kana(a, plain[a:b], ruby[c:d])
    return out


def test_difference(spark):
    rng, rows = random.Random(7), []
    for i in range(60):
        plain, ruby = "", ""
        for _ in range(rng.randrange(12)):
            word = "".join(rng.choice("木本東京大阪山川田中ABCDE") for _ in range(rng.randrange(1, 4))) + rng.choice("あいう") * rng.randrange(2)
            ruby += "よみかた"[: rng.randrange(2, 5)] if rng.random() < 0.2 else word
            plain += word
            mark = rng.choice(["", "。", "、", "\n"])
            plain, ruby = plain + mark, ruby + mark
        rows.append((i, plain, ruby))
    rows += [(100, None, "x"), (101, "x", None), (102, "漢字", "かんじ"), (103, "同じ", "同じ")]
    got = collections.defaultdict(list)
    for r in tracking.diff_spans(spark.createDataFrame(rows, "chapter long, plain string, ruby string")).collect():
        got[r.chapter].append((r.start, r.end, r.base, r.reading))
    for i, plain, ruby in rows:
        want = [x for x in differences(plain or "", ruby or "") if not re.search(f"[{books.KANJI}]", x[3]) and len(x[3]) <= max(24, 6 * len(x[2])) and "\n" not in x[2] + x[3]]
        assert sorted(got[i]) == sorted(want), (plain, ruby)
    assert got[102] == [(0, 2, "漢字", "かんじ")]


def test_difference_of_a_long_text(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("木本東京大阪山川田中abcdefgh") for _ in range(6)) for _ in range(4000)]
    plain = "".join(rng.choice(words) + rng.choice(["", "。"]) for _ in range(150_000))
    at = [m.start() for m in re.finditer("東京", plain)]
    ruby = plain.replace("東京", "とうきょう")
    got = tracking.diff_spans(spark.createDataFrame([(1, plain, ruby)], "chapter long, plain string, ruby string")).collect()
    assert len(plain) > 900_000 and len(got) == len(at)
    assert all(plain[r.start : r.end] == r.base for r in got)
    # without a mark in the whole text, the helper finds its own anchors
    bare = plain.replace("。", "")[:300_000]
    spoken = bare.replace("東京", "とうきょう")
    pairs = [(bare[i:j], spoken[k:m]) for i, j, k, m in A.replacements(bare, spoken)]
    assert pairs.count(("東京", "とうきょう")) > 0.98 * bare.count("東京")


def test_split_on_kana():
    assert A.split_on_kana(3, "食べ物", "たべもの") == [(3, 4, "食", "た"), (5, 6, "物", "もの")]
    assert A.split_on_kana(0, "お金持ち", "オカネモチ") == [(1, 3, "金持", "かねも")]
    assert A.split_on_kana(0, "子の子の子", "このこのこ") == [(0, 1, "子", "こ"), (2, 3, "子", "こ"), (4, 5, "子", "こ")]
    assert A.split_on_kana(0, "漢字", "かんじ") == [(0, 2, "漢字", "かんじ")]
    assert A.split_on_kana(0, "読む", "みる") == []


# ---- chapters


def book(spark, pages, toc=()):
    items = spark.createDataFrame([("b", i, href, html) for i, (href, html) in enumerate(pages)], "book string, pos long, href string, html string")
    contents = spark.createDataFrame([("b", i, href, title) for i, (href, title) in enumerate(toc)], "book string, ord long, href string, title string")
    return chapters.chapters_of(items, contents).orderBy("ord").collect()


BODY = "<p>" + "本文です。" * 100 + "</p>"


def test_title_page_is_put_before_the_body(spark):
    got = book(spark, [("title.xhtml", "<h1>森の奥</h1>"), ("body.xhtml", f"<p>「おじさん」</p>{BODY}")])
    assert [(c.title, c.n_pages, c.by) for c in got] == [("森の奥", 1, "order")]
    assert got[0].text.startswith("森の奥\n\n「おじさん」\n本文") and got[0].headings == ["森の奥"]


def test_title_page_stays_before_a_numbered_heading(spark):
    got = book(spark, [("title.xhtml", "<h1>森の奥</h1>"), ("body.xhtml", f"<p>１</p>{BODY}")])
    assert [c.title for c in got] == ["森の奥", "１"]


def test_filename_as_title_gives_way_to_the_body(spark):
    got = book(spark, [("text/c1.xhtml", f"<p>これは先頭の本文です。</p>{BODY}")], [("text/c1.xhtml", "c1.xhtml")])
    assert [(c.title, c.by) for c in got] == [("これは先頭の本文です。", "contents")]


def test_empty_title_page_passes_its_title_on(spark):
    pages = [("t.xhtml", "<img src='x.png'>"), ("a.xhtml", BODY), ("b.xhtml", f"<h2>第二章</h2>{BODY}")]
    got = book(spark, pages, [("t.xhtml", "第一章 はじまり"), ("b.xhtml", "第二章")])
    assert [(c.title, c.by) for c in got] == [("第一章 はじまり", "order"), ("第二章", "order")]
    assert got[0].text.startswith("第一章 はじまり\n\n本文")
    plain = book(spark, pages, [("t.xhtml", "目次"), ("b.xhtml", "第二章")])
    assert plain[0].title.startswith("本文です。") and not plain[0].text.startswith("目次")


def test_inline_contents_name_chapters(spark):
    links = "".join(f"<p><a href='{h}.xhtml#x'>{t}</a></p>" for h, t in (("a", "一の話"), ("b", "二の話"), ("c", "三の話")))
    got = book(spark, [("toc.xhtml", links), *((f"{h}.xhtml", BODY) for h in "abc")], [("zz.xhtml", "表題")])
    assert [c.title for c in got][-3:] == ["一の話", "二の話", "三の話"]


def test_split_series_is_one_chapter(spark):
    pages = [("x_split_000.html", f"<h1>序章</h1>{BODY}"), ("x_split_001.html", BODY), ("y_split_000.html", f"<h1>終章</h1>{BODY}"), ("y_split_001.html", f"<h1>後書き</h1>{BODY}")]
    got = book(spark, pages, [("x_split_000.html#a", "序章"), ("y_split_000.html", "終章"), ("y_split_001.html", "後書き"), ("y_split_000.html#again", "終章の二")])
    assert [(c.title, c.n_pages, c.by) for c in got] == [("序章", 2, "contents"), ("終章", 1, "contents"), ("後書き", 1, "contents")]


def test_pages_without_an_entry(spark):
    # a page that goes on is folded in, one that starts with a structural heading is not, nor is what stands behind that
    pages = [("a.html", f"<h1>一</h1>{BODY * 9}"), ("n.html", "<p>つづき。</p>"), ("s.html", "<h2>第二章</h2><p>短い。</p>"), ("r.html", "<p>ここも。</p>"), ("z.html", f"<h1>結び</h1>{BODY * 9}")]
    got = book(spark, pages, [("a.html", "はじめの章"), ("z.html", "結び")])
    assert [(c.title, c.n_pages) for c in got] == [("はじめの章", 2), ("結び", 1)] and got[0].text.endswith("\n\nつづき。")
    # when the contents lead to too little of the text, the order of the pages decides
    far = book(spark, pages, [("n.html", "つづき")])
    assert {c.by for c in far} == {"order"} and sum(c.n_pages for c in far) == 5


def test_notes_and_ruby(spark):
    one = "<p><ruby>漢<rt>かん</rt></ruby>字<a id='r1' href='b.html#n1'>1</a>と<ruby>仮名<rt>かな</rt></ruby>。</p>"
    got = book(spark, [("a.html", one), ("b.html", "<p><span id='n1'><a href='a.html#r1'>1</a></span>注の文。</p><p>年は<a href='#other'>1999年</a>。</p>")])
    text = "\n\n".join(c.text for c in got)
    assert text == "漢字と仮名。\n\n注の文。\n年は1999年。"
    spans = [(r.start, r.end, r.base, r.reading) for c in got for r in c.ruby]
    assert spans == [(0, 1, "漢", "かん"), (3, 5, "仮名", "かな")]


def test_no_pages(spark):
    assert book(spark, []) == []
    assert book(spark, [("a.html", None), ("b.html", "")], [("a.html", None)]) == []


def driver(pages, toc):
    """The same for one book: pages (href, html) without links, notes, or ruby; toc (href, title)."""
    read = [(h, H.read_html(x)) for h, x in pages]
    texts, heads = [r["text"] for _, r in read], [[x["text"] for x in r["headings"]] for _, r in read]
    hrefs = [h for h, _ in pages]
    squeeze = lambda x: re.sub(r"\s+", " ", x).strip()

    def filename(t, h):
        t, name = (t or "").strip(), h.split("/")[-1]
        stem = name.rsplit(".", 1)[0]
        return not t or t in (h, name, stem) or bool(re.search(r"\.x?html$", t.lower())) or t.lower() == stem.lower() or bool(re.fullmatch(r"[a-z]\d+[a-z0-9]*", t.lower()))

    def first(text):
        return next((x.strip(" ") for x in text.split("\n") if x.strip(" ")), "")

    def from_text(text):
        line = first(text)
        return line[:40].rstrip(" ") + "..." if len(line) > 40 else line

    def pick(given, i, number):
        for t in (given, heads[i][0] if heads[i] else "", from_text(texts[i])):
            if not filename(t, hrefs[i]):
                return t.strip()
        return f"Chapter {number}"

    structural = re.compile(r"第?\d+[章話部節巻回篇編]|\d+[.)．、]|[IVXLCDM]+[章話部節巻回篇編.)．、]")
    struct = lambda t: squeeze(t).lower() in T.STRUCTURAL or (len(t) <= 80 and bool(structural.match(t.strip())))
    non = lambda t: squeeze(t or "").lower() in ("", *T.NON_CONTENT)
    given = {}
    for h, t in toc:
        if (t or "").strip():
            given[h.split("#")[0]] = t.strip()
    # reading order
    spine, number = [], 0
    named = {i for i, h in enumerate(hrefs) if not filename(given.get(h), h)}
    for i, h in enumerate(hrefs):
        if texts[i]:
            number += 1
            title = pick(given.get(h), i, number)
            t = given.get(h, title)
            fragment = filename(t, h) or (not heads[i] and bool(from_text(texts[i])) and squeeze(t) == squeeze(from_text(texts[i])) and not struct(t))
            if spine and i not in named and named and fragment:
                spine[-1][1].append(i)
            else:
                spine.append((title, [i]))
    # contents
    series = [(m[1], m[2]) if (m := re.match(r"(.+?)(?:_split_|-split-)\d+(\.[^./]+)$", h)) else None for h in hrefs]
    entries = list({h.split("#")[0]: t for h, t in reversed(toc)}.items())[::-1]
    times = collections.Counter(series[hrefs.index(h)] for h, _ in entries if h in hrefs)
    found, bounds = [], set(named) | {hrefs.index(h) for h, _ in entries if h in hrefs}
    for n, (h, t) in enumerate(entries, 1):
        if h in hrefs:
            i = hrefs.index(h)
            parts = [i]
            if series[i] and times[series[i]] == 1 and (i == 0 or series[i - 1] != series[i]):
                while parts[-1] + 1 < len(hrefs) and series[parts[-1] + 1] == series[i]:
                    parts.append(parts[-1] + 1)
            if any(texts[k] for k in parts):
                found.append((pick(t, i, n), parts))
    size = lambda c: len("\n\n".join(texts[k] for k in c[1] if texts[k]))
    total = sum(len(texts[k]) for _, p in spine for k in p)
    if not total:
        return []
    by = "contents" if sum(len(texts[k]) for _, p in found for k in p) >= 0.9 * total else "order"
    out = spine
    if by == "contents":
        held = {k for _, p in found for k in p}
        for title, parts in found:
            if not non(title) and not filename(title, hrefs[parts[0]]):
                k = parts[0] + 1
                while k < len(hrefs) and k not in bounds:
                    if k not in held:
                        if any(map(struct, heads[k])) or (texts[k].strip() and struct(first(texts[k]))):
                            break
                        parts.append(k)
                    k += 1
        out = found
    assert size(out[0]) >= 0
    return [(t, hrefs[p[0]], "\n\n".join(texts[k] for k in sorted(p) if texts[k]), len(p), by) for t, p in out]


def test_chapters_of_pages(spark, sf):
    items, toc = books.books_of(spark, sf)
    pages, contents = collections.defaultdict(list), collections.defaultdict(list)
    for r in items.orderBy("book", "pos").collect():
        pages[r.book].append((r.href, re.sub(r"<nav>.*?</nav>", "", r.html)))
    for r in toc.orderBy("book", "ord").collect():
        contents[r.book].append((r.href, r.title))
    bare = items.withColumn("html", F.regexp_replace("html", "(?s)<nav>.*?</nav>", ""))
    got = collections.defaultdict(list)
    for r in chapters.chapters_of(bare, toc).orderBy("book", "ord").collect():
        got[r.book].append((r.title, r.source, r.text, r.n_pages, r.by))
    for b in pages:
        assert got[b] == driver(pages[b], contents[b]), b
    assert {c[4] for x in got.values() for c in x} == {"contents", "order"}


def test_notes_leave_no_trace(spark, sf):
    plain = {r.page_id: H.read_html(r.html)["text"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import hashlib

    got = {r.page_id: r.h for r in books.QUERIES["j13_notes"](spark, sf).collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in plain.items()}


# ---- small capitals, growth, layers


def test_small_capitals(spark):
    rows = [
        (1, "THE OLD MAN sat down.\n\nAn old Man and a man, a man.\n\nTHE OLD MAN\n\nBBC NEWS AT TEN was on."), (2, "KING-HENRY'S MEN AND THE rest"), (3, "ABC XYZ went"), (4, None), (5, ""), (6, "ONE TWO THREE FOUR FIVE SIX SEVEN eight the"),
        (7, "“THE IV KINGS came.\n \nMcDonald IS MCDONALD and MCDONALD’S mcdonald McDonald"), (8, "MCDONALD AND the McDonald"), (9, "Über ÜBER the über\n\nÜBER THE hill"),
    ]
    got = {r.doc: r.text for r in casing.small_capitals(spark.createDataFrame(rows, "doc long, text string")).collect()}
    assert got[1] == "The old man sat down.\n\nAn old Man and a man, a man.\n\nTHE OLD MAN\n\nBBC news at TEN was on."
    assert got[2] == "King-Henry'S MEN and the rest" and got[3] == "ABC XYZ went"
    assert got[4] is None and got[5] == "" and got[6] == rows[5][1]
    assert got[7].startswith("“The IV kings came.\n\nMcDonald IS") and got[8] == "McDonald and the McDonald" and got[9].endswith("Über the hill")


def test_growth(spark):
    texts = spark.createDataFrame([(1, "東京都庁に行って来た"), (2, "")], "chapter long, text string")
    spans = spark.createDataFrame([(1, 1, 2, 0), (1, 0, 4, 1), (1, 4, 5, 2), (1, 6, 7, 3), (1, 8, 9, 4), (1, 3, 5, 5), (1, 9, 11, 6), (1, -1, 2, 7), (2, 0, 1, 8), (1, 2, 2, 9)], "chapter long, start long, end long, id int")
    got = {r.id: (r.surface_end, r.run_start, r.run_end) for r in S.grown(texts, spans, T.KANJI, T.KANA).collect()}
    assert got == {0: (2, 0, 4), 1: (5, 0, 4), 2: (5, None, None), 3: (8, None, None), 4: (10, None, None), 5: (5, None, None)}


def test_layers_without_pairs(spark):
    plan = S.layered(spark.createDataFrame([], "chapter long, layer int, start long, end long"))._jdf.queryExecution().toString()
    assert "Join" not in plan


# ---- sinks and upserts


def files(path):
    return sorted((str(p.relative_to(path).parent), p.stat().st_size) for p in Path(path).rglob("*.parquet") if "manifest" not in str(p))


def test_publish_again_after_a_failure(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    rows = [(b, c, k, f"{b}.{c}.{k}") for b in (1, 2) for c in (1, 2, 3) for k in range(4)]
    chunks = lambda r: spark.createDataFrame(r, "book long, chapter long, chunk long, text string")
    sinks.write_chunks(chunks(rows), at)
    before = files(tmp_path / "t")
    state = sorted(map(tuple, sinks.manifest(spark, at).collect()))
    assert len(state) == 6 and all(r[2] == 4 for r in state)
    failing = chunks(rows).withColumn("text", F.when(F.col("chapter") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_chunks(failing, at)
    assert files(tmp_path / "t") == before and sorted(map(tuple, sinks.manifest(spark, at).collect())) == state
    sinks.write_chunks(chunks(rows), at)
    assert files(tmp_path / "t") == before and sorted(map(tuple, sinks.manifest(spark, at).collect())) == state
    # book 1 loses a chapter, book 2 isn't touched
    sinks.write_chunks(chunks([r for r in rows if r[0] == 1 and r[1] < 3]), at)
    assert sorted((r[0], r[1]) for r in sinks.manifest(spark, at).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert spark.read.parquet(f"{at}/data").count() == 20
    with pytest.raises(ValueError, match="key"):
        sinks.write_chunks(chunks([(None, 1, 1, "x")]), at)


def test_small_files(spark, tmp_path):
    at = f"file://{tmp_path}/x.json"
    for n in (1, 2):
        sinks.write_text(spark, at, json.dumps({"a": n}))
    (tmp_path / "y.json").write_text("{broken")
    got = {r.path.split("/")[-1]: r.value for r in sinks.read_json(spark, f"file://{tmp_path}/*.json", "a int").collect()}
    assert got["x.json"].a == 2 and (got["y.json"] is None or got["y.json"].a is None)
    assert sinks.read_json(spark, f"file://{tmp_path}/none/*.json", "a int").collect() == []
    assert not list(tmp_path.glob("*.tmp"))


def test_books_to_files(spark, tmp_path):
    items = spark.createDataFrame([("b", 0, "a.html", f"<h1>一</h1>{BODY}"), ("b", 1, "c.html", f"<h1>二</h1>{BODY}")], "book string, pos long, href string, html string")
    toc = spark.createDataFrame([], "book string, ord long, href string, title string")
    at = f"file://{tmp_path}/books"
    sinks.write_books(chapters.chapters_of(items, toc), at)
    got = spark.read.parquet(f"{at}/toc/data").orderBy("index").collect()
    assert [(r['index'], r.title) for r in got] == [(1, "一"), (2, "二")] and sinks.manifest(spark, f"{at}/chapters").count() == 1


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    src, at = tmp_path / "in", tmp_path / "t"
    schema = "book long, event_id long, position long"

    def send(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        stream = spark.readStream.schema(schema).parquet(f"file://{src}")
        boundary.upsert_positions(stream, spark, f"file://{at}", f"file://{tmp_path}/check")
        return {r.book: (r.last, r.furthest) for r in boundary.positions(spark, f"file://{at}").collect()}

    assert send([(b, b, 10 * b) for b in range(200)] + [(None, 1, 1)], 0) == {b: (10 * b, 10 * b) for b in range(200)}
    before = {p for p in at.rglob("*.parquet")}
    got = send([(3, 500, 7), (3, 499, 99), (777, 1, None)], 1)
    assert got[3] == (7, 99) and got[777] == (None, None) and got[5] == (50, 50) and len(got) == 201
    new = {p for p in at.rglob("*.parquet")} - before
    assert len({p.parent.parent.name for p in new}) == len({r.b for r in spark.sql(f"SELECT pmod(xxhash64(x), {boundary.BUCKETS}) AS b FROM VALUES (3L), (777L) AS t(x)").collect()})
    assert send([(3, 501, 8)], 2)[3] == (8, 99)
