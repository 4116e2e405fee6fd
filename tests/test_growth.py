"""Work that grows no faster than the input, and texts of the lengths where spans meet."""

import difflib
import random
import re
import sys
import time
import unicodedata
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from compare import oracle_rows, rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom import plans, sinks
from textloom.functions import alignment, spoken, text, unicode
from textloom.operators import casing, chapters, joins, overrides, preparation, sections, tracking
from textloom.operators import spans as S
from textloom.plans import reading
from textloom.plans.common import BATCH_BYTES, table


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replaced_spans_at_every_length(spark, tmp_path):
    rows = [(n, "".join(chr(97 + i % 26) for i in range(n))) for n in [*range(60), 303, 304, 305, 310, 311, 312]] + [(999, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = oracle_rows_of(plans.oracle_sql()["f40_replace_spans"], tmp_path)
    assert rows_of(plans.queries()["f40_replace_spans"](spark, str(tmp_path))) == want


def oracle_rows_of(sql, path):
    """oracle_rows over the documents alone, in a folder of Parquet files."""
    return oracle_rows(f"WITH documents AS (SELECT * FROM '{path}/documents.parquet/*.parquet'), {sql.removeprefix('WITH ')}", plans_folder())


def plans_folder():
    return "/root/testdata/sf0.001"


def test_followers_without_pairs(spark):
    starts = spark.createDataFrame([(1, 1), (1, 5), (1, 5), (2, 3), (None, 1)], "book long, pos long")
    items = spark.createDataFrame([(1, 0, True), (1, 2, True), (1, 3, False), (1, 4, True), (1, 5, False), (1, 6, True), (2, 4, True), (2, 5, None), (None, 2, True)], "book long, pos long, continues boolean")
    got = joins.followers(starts, items)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (1, 5, 6), (2, 3, 4), (2, 3, 5)]
    assert "Join" not in plan_of(got)


def test_breaks_without_pairs(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 4), (1, 6, 6, 9), (1, 12, 12, 14), (2, 0, 0, 3)], "chapter long, chunk long, start long, end long")
    breaks = spark.createDataFrame([(1, 4), (1, 10), (1, 10), (1, 8), (1, 13), (2, 2)], "chapter long, pos long")
    got = S.breaks_before_next(chunks, breaks)
    assert sorted(map(tuple, got.collect())) == [(1, 0, True), (1, 6, True), (1, 12, False), (2, 0, False)]
    assert "Join" not in plan_of(got)


def test_files_of_a_sink_dont_grow_with_its_chapters(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    sinks.write_chunks(spark.range(600).selectExpr("id % 2 AS book", "id AS chapter", "0L AS chunk", "'x' AS text"), at)
    files = list((tmp_path / "t/data").rglob("*.parquet"))
    assert len(files) <= 2 * 4 and {p.parent.name for p in files} == {"book=0", "book=1"}
    assert sinks.manifest(spark, at).count() == 600


def test_signs_are_counted_in_their_document(spark):
    texts = spark.createDataFrame([(1, "a\n\n***\n\nb\n\n***\n\nc"), (2, "a*\n***\nb"), (3, "no signs"), (4, None), (5, "a\n\n†\n\nb")], "doc long, text string")
    got = sections.markers(texts)
    assert sorted(map(tuple, got.collect())) == [(1, "***"), (5, "†")]
    assert "LeftSemi" not in plan_of(got)  # no row for each sign of a text


def test_numbers_of_every_kind_are_spoken(spark):
    query, sql = plans.queries()["f33_spoken"], plans.oracle_sql()["f33_spoken"]
    got = rows_of(query(spark, plans_folder()))
    assert got == oracle_rows(sql, plans_folder())
    assert {"全ななさつ 合本版", "さんぶんのに", "しがつ"} <= {r[got[0].index("spoken")] for r in got[1]}


def test_cleaned_texts_are_read_from_a_table(spark):
    got = sections.normalise(spark.createDataFrame([(1, "a\n\n†\n\nb"), (2, None)], "doc long, text string"))
    assert "parquet" in plan_of(got) and not any(x in plan_of(got) for x in ("LogicalRDD", "LocalRelation"))
    assert got.count() == 2


def test_periodic_texts_are_aligned(spark):
    plain = "水東日うえ水 木う木, " * 1500
    read = re.sub("木う木(?=,)", lambda m: "よみうかた" if m.start() % 3 else m[0], plain)
    started = time.monotonic()
    got = tracking.diff_spans(spark.createDataFrame([(1, plain.replace(",", ";"), read.replace(",", ";"))], "chapter long, plain string, ruby string")).collect()
    assert time.monotonic() - started < 60
    want = [(i, "木", r) for m in re.finditer("木う木(?=,)", plain) if m.start() % 3 for i, r in ((m.start(), "よみ"), (m.start() + 2, "かた"))]
    assert sorted((r.start, r.base, r.reading) for r in got) == want


def test_common_subsequences_are_the_longest(monkeypatch):
    def size(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
        return row[-1]

    rng = random.Random(3)
    for bits in (1 << 28, 8):  # the whole table, or halves of it
        monkeypatch.setattr(alignment, "BITS", bits)
        for _ in range(200):
            a, b = ("".join(rng.choice(signs) for _ in range(rng.randrange(30))) for signs in ("abc", "abx"))
            got = list(alignment._common(a, b))
            assert len(got) == size(a, b) and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_matches_are_found_once_for_each_size_of_pieces(monkeypatch):
    """The blocks of difflib; what lies before and behind a match isn't looked through again for pieces of the same size."""
    rng = random.Random(1)
    for _ in range(500):
        signs = rng.choice(("ab", "abcd", "abcdefghij"))
        a, b = ("".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(2))
        if rng.random() < 0.5:
            b = a[: rng.randrange(60)] + b[:9] + a[rng.randrange(60) :]
        got = []
        for i, j, n in alignment._blocks(a, b):  # neighbours are one match to difflib
            if got and (got[-1][0] + got[-1][2], got[-1][1] + got[-1][2]) == (i, j):
                i, j, n = *got[-1][:2], got.pop()[2] + n
            got.append((i, j, n))
        assert got == [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()][:-1]
    seen, find = [], alignment._diagonals
    monkeypatch.setattr(alignment, "_diagonals", lambda a, b, a0, a1, b0, b1, k: seen.append(a1 - a0) or find(a, b, a0, a1, b0, b1, k))
    words = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(60)]
    alignment._blocks(" ".join(words), " ".join(w.upper() if i % 3 == 0 else w for i, w in enumerate(words)))
    assert sum(seen) < 5 * 13 * 60  # once for each size at most, however many matches there are


def test_differences_shuffle_their_gaps_only(spark):
    got = tracking.diff_spans(spark.range(9).selectExpr("id AS chapter", "concat('木本。同じ', id, '。') AS plain", "concat('もと。同じ', id, '。') AS ruby"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    assert sorted(map(tuple, got.collect())) == [(i, 0, 2, "木本", "もと") for i in range(9)]


def test_gaps_are_spread_over_tasks(spark):
    got = tracking.diff_spans(spark.createDataFrame([(i, "木本。", "もと。") for i in range(40)], "chapter long, plain string, ruby string"))
    assert "Repartition" in plan_of(got) and got.count() == 40


def test_growth_makes_no_row_for_each_run(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("木本あいx") for _ in range(rng.randrange(60)))) for i in range(40)] + [(99, None)]
    spans = [(i, a, b, a * 100 + b) for i, _ in rows for a in range(-1, 50, 3) for b in (a, a + 1, a + 4)]
    got = S.grown(spark.createDataFrame(rows, "chapter long, text string"), spark.createDataFrame([*spans, *spans[:5]], "chapter long, start long, end long, id long"), "木本", "あい")
    want = []
    for i, t in rows:
        for _, a, b, k in (s for s in spans if s[0] == i and t is not None and 0 <= s[1] < s[2] <= len(t)):
            run = next((m.span() for m in re.finditer("[木本]+", t) if m.start() <= a < m.end()), (0, 0))
            fits = run[1] >= b and run[1] - run[0] > 1
            want.append((i, a, b, k, re.compile("[あい]*").match(t, b).end(), *(run if fits else (None, None))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "Window" not in plan_of(got)


def test_layers_keep_their_partitions(spark):
    rows = [(c, (i + c) % 3, i * 7 % 90, i * 7 % 90 + 1 + i % 5) for c in range(30) for i in range(20)]
    got = S.layered(spark.createDataFrame(rows, "chapter long, layer int, start long, end long").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chapter"))))
    fits = lambda r, taken: not any(o[0] == r[0] and o[2] < r[3] and r[2] < o[3] for o in taken)
    kept = [r for r in rows if r[1] == 0]
    for layer in (1, 2):
        kept += [r for r in rows if r[1] == layer and fits(r, list(kept))]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(kept)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_compatibility_forms(spark):
    keep = re.compile("([…⋯]+)")
    texts = ["", "ｶﾞ", "か\u3099", "が…", "…Ⅳ⋯①", "plain", "Å", "\u1100\u1161", None]
    want = [None if t is None else "".join(p if keep.fullmatch(p) else unicodedata.normalize("NFKC", p) for p in keep.split(t)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unicode.nfkc("t").alias("n")).collect()
    assert [r.n for r in sorted(rows)] == want


def test_rules_look_for_rare_signs_first(spark):
    plan = plan_of(spark.createDataFrame([("木 山",)], "t string").select(text.space_to_pause(text.wave_dashes(text.without_single_quotes(F.col("t"))))))
    assert all(f"(?={x}" in plan for x in ("['", " )", "~)"))


def test_spans_of_a_chunk_meet_its_text_as_one_row(spark):
    rng = random.Random(7)
    chunks = [(c, k, k * 50, k * 50 + 40, "".join(rng.choice("木本山あいx \U00020000") for _ in range(40))) for c in range(12) for k in range(3)] + [(99, 0, 0, 9, None), (98, 0, 0, 0, "")]
    readings = ["かな", "カナ", "ｶﾅ", "木", "か" * 25, " ", "", None, "a\n", "㍍"]
    spans = []
    for c, _, at, _, t in chunks[:36]:
        for _ in range(rng.randrange(14)):
            a = rng.randrange(40)
            b = a + rng.choice((0, 1, 1, 1, 1, 2, 3, 9))  # overlaps, and spans beyond the chunk
            spans.append((c, at + a, at + b, t[a:b] if rng.random() < 0.8 else "山", rng.choice(readings[:2] if rng.random() < 0.6 else readings)))
    c = spark.createDataFrame(chunks, "chapter long, chunk int, start long, end long, text string")
    s = spark.createDataFrame([*spans, (99, 1, 2, "木", "き")], "chapter long, start long, end long, base string, reading string")
    got = preparation.ruby_evidence(c, s)
    want = []
    for c_, k, at, end, t in chunks:
        runs = []
        for start, stop, x, base in sorted((i - at, j - at, r, x) for c2, i, j, x, r in spans if c2 == c_ and r and at <= i and j <= end):
            one = len(base) == 1 and base in "木本山\U00020000" and set(x) <= set("かなカナｶﾅ")
            if one and runs and runs[-1][4] and runs[-1][1] == start:
                runs[-1] = (runs[-1][0], stop, runs[-1][2] + base, runs[-1][3] + x, True)
            else:
                runs.append((start, stop, base, x, one))
        for start, stop, base, x, _ in sorted(runs, reverse=True):
            if not preparation._suspicious(base, x) and t[start:stop] == base:
                t = t[:start] + preparation._script(x) + t[stop:]
        want.append((c_, k, at, end, t))
    columns = ["chapter", "chunk", "start", "end", "text"]
    rows = lambda df: sorted(map(str, map(tuple, df.select(*columns).collect())))
    assert rows(got) == sorted(map(str, want)) != rows(c)
    pairs = spark.createDataFrame([(x, r) for x in ("木", "木x", "", " ", "a\n", "木本山木本") for r in readings if r is not None], "base string, reading string")
    for r in pairs.select("base", "reading", text.is_suspicious(F.col("base"), F.col("reading")).alias("bad"), preparation.reading_script(F.col("reading")).alias("script")).collect():
        assert (preparation._suspicious(r.base, r.reading), preparation._script(r.reading)) == (r.bad, r.script)
    assert plan_of(got).count("Window [") == 1  # of the meeting only: runs are joined where the text is


def test_a_row_for_each_forty_signs(spark):
    rows = [(1, 0, 0, "木本山あい" * 20), (1, 1, 101, "木\U00020000本" * 30), (1, 2, 192, ""), (2, 0, 0, "x"), (3, 0, 81, "ab"), (4, 0, 0, None)]
    got = reading.spans_of(spark.createDataFrame(rows, "chapter long, chunk int, start long, text string"))
    want = [(c, at + i, at + i + 1, x, "かな") for c, _, at, t in rows for i, x in enumerate(t or "") if (at + i) % 40 < 2]
    assert sorted(map(tuple, got.collect())) == want
    assert "split(" not in plan_of(got)


def test_rules_of_numbers_pass_over_texts_without_any(monkeypatch):
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice("0129〇一二十百万年月日分の時第%.,:/~Ⅳ木あ… x三") for _ in range(rng.randrange(12)))
        want = spoken._ROMAN_LETTERS.sub(lambda m: m[0], spoken._ROMAN_GLYPHS.sub(lambda m: spoken.kana(spoken.roman(unicodedata.normalize("NFKC", m[0]))) if spoken.roman(unicodedata.normalize("NFKC", m[0])) else m[0], t))
        want = "".join(p if p[:1] in "…⋯" else unicodedata.normalize("NFKC", p) for p in re.split("([…⋯]+)", want) if p)
        for pattern, rule, _ in spoken.RULES:
            want = re.sub(pattern, lambda m, r=rule: m[0] if (x := r(m)) is None else x, want)
        assert spoken.speak(t) == want
    monkeypatch.setattr(spoken, "_RULES", [(None, *r[1:]) for r in spoken._RULES])  # none of them is tried
    assert spoken.speak("木本山 あい, x") == "木本山 あい, x"


def test_plain_texts_are_looked_at_once(spark):
    texts = ["木本 山", "木。" + "」" * 40, "木" + "」" * 40, "木。\r", "木…」 ", "ab c", "", " ", "木 " * 40, "“木”", "木――山 川", "木~山", "é ü ß", "木­本 山"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    stops = lambda c, closers: c.rlike(f"[{text.END_MARKS}{text.PAUSE_MARKS}][{closers}]*$")
    got = d.select(text._ends_with(F.col("t"), text.END_MARKS + text.PAUSE_MARKS, text.CHUNK_CLOSERS).alias("a"), stops(F.col("t"), text.CHUNK_CLOSERS).alias("b"), "t", (~F.col("t").rlike(f"[^{text.PLAIN}]")).alias("plain"))
    rows = got.collect()
    assert all(r.a == r.b for r in rows) and {r.t for r in rows if r.plain} == {"木本 山", "ab c", "", " ", "木 " * 40, "é ü ß"}
    assert text.PLAIN in plan_of(d.select(preparation.prepare(F.col("t"))))


def test_words_are_looked_up_in_their_text(spark):
    rows = [(1, "THE OLD HOUSE stood. old House house House, the"), (2, "no run here"), (3, None), (4, "THE CAT sat\n\nTHE DOG ran. Dog dog dog Cat")]
    got = casing.small_capitals(spark.createDataFrame(rows, "doc long, text string"))
    want = {1: "The old House stood. old House house House, the", 2: "no run here", 3: None, 4: "The CAT sat\n\nThe dog ran. Dog dog dog Cat".replace("CAT", "Cat")}
    assert {r.doc: r.text for r in got.collect()} == want
    assert "LeftSemi" not in plan_of(got) and plan_of(got).count("Join") == 1  # no row for each word of a text


def test_a_book_is_not_one_task(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "en" if i % 5 else None if i % 2 else "fr", "the tin. eau" if i % 7 else None) for i in range(60)], "id long, lang string, text string")
    entries = spark.createDataFrame([("en", 0, "th", None, "TH", None), ("en", 1, None, "([aeiou])n", r"\1ン", None), ("fr", 0, "eau", None, "オ", None)], "lang string, ord int, base string, pattern string, reading string, mode string")
    got = overrides.apply_overrides(texts, entries, ["lang"])
    assert "strategy=broadcast" in plan_of(got)
    want = sorted(map(str, got.collect()))
    said = {"en": "THe tiン. eau", "fr": "the tin. オ", None: "the tin. eau"}
    assert [(r.id, r.text) for r in sorted(got.collect(), key=lambda r: r.id)] == [(r.id, r.text and said[r.lang]) for r in sorted(texts.collect(), key=lambda r: r.id)]
    monkeypatch.setattr(overrides, "SENT_BYTES", -1)  # dictionaries too large to be sent
    dealt = overrides.apply_overrides(texts, entries, ["lang"])
    assert "__salt" in plan_of(dealt) and "strategy=broadcast" not in plan_of(dealt)
    assert sorted(map(str, dealt.collect())) == want


def windows(node):
    kids = node.children()
    return [node.output().mkString(",")] * (node.nodeName() == "Window") + [x for i in range(kids.size()) for x in windows(kids.apply(i))]


def test_books_are_put_in_order_without_their_texts(spark):
    pages = spark.createDataFrame([("b", i, f"p{i}.html", f"Page {i}\n" + "x" * 200, [], ["Page"], None, []) for i in range(6)], "book string, pos int, href string, text string, ruby array<struct<start: int, end: int, base: string, reading: string>>, headings array<string>, series string, links array<struct<href: string, label: string>>")
    toc = spark.createDataFrame([("b", 0, "p0.html", "One"), ("b", 3, "p3.html", "Two")], "book string, ord int, href string, title string")
    titles = chapters.titles_from_contents(pages, toc)
    contents = chapters.contents_parts(pages, toc)
    whole = chapters.assemble(contents.unionByName(chapters.followers(pages, titles, toc, contents)))
    for df in (chapters.spine_parts(pages, titles), contents, chapters.followers(pages, titles, toc, contents), chapters.absorb_title_pages(spark.createDataFrame(whole.collect(), whole.schema))):
        found = windows(df._jdf.queryExecution().optimizedPlan())
        assert found and not any("ruby#" in x for x in found)
    assert sorted((r.ord, r.title, r.n_pages, len(r.text)) for r in whole.collect()) == [(1, "One", 3, 3 * 207 + 4), (2, "Two", 3, 3 * 207 + 4)]


def test_arrow_batches_end_at_so_many_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    table(spark, plans_folder(), "pages")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
