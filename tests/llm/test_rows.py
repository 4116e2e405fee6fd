"""Repeated rows, null ids, large ids and clashing names: what each operator makes of them."""

import random
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
from textloom.llm import decontam, html_extract, langid, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, toxicity

LINE = "a line that is long enough to be a key"


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(docs).collect())
    more = docs.unionByName(spark.createDataFrame([(None, LINE), (None, LINE)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(more).collect()) == [(0, 1), (0, 1), (1, 1), (1, 1), (2, 0)]


@pytest.mark.parametrize("bound", [48 << 20, -1])
def test_line_paths_on_odd_rows(spark, monkeypatch, bound):
    """The filters are asked on both sides of the bound; string ids and nulls pass; a hot line in many documents goes."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
    rows = [(f"d{i:03}", f"{LINE}\nown line of number {i} here\n{LINE.upper()}  ") for i in range(200)] + [(None, LINE), ("d000", None), ("d001", ""), ("d199", LINE)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string").withColumn("n", F.lit(1)), extra=("n",)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.n_lines == 3:
            number = int(r.doc_id[1:])
            assert (r.n_dropped, r.kept) == ((0, f"{LINE}\nown line of number 199 here\n{LINE.upper()}  ") if number == 199 else (2, f"own line of number {number} here"))
        else:
            assert r.n_dropped == (r.doc_id is None)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string").withColumn("kept", F.lit(1)), extra=("kept",))


def test_line_index_touches_its_shards(spark):
    docs = spark.createDataFrame([(2**53 + i, f"{LINE}\nanother line, of pair {i // 3}, long enough") for i in range(9)], "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=8)
    index.insert(docs.limit(0))
    assert index.version == 0 and all(r.n_dropped == 0 for r in index.apply(docs).collect())
    index.insert(docs)
    before = dict(index.holds)
    index.insert(docs.filter("doc_id < 0"))
    assert index.holds == before
    one = spark.createDataFrame([(2**53 + 9, LINE)], "doc_id long, text string")
    index.insert(one)
    assert sum(v == index.version for v in index.holds.values()) == 1
    assert {r.doc_id: r.n_dropped for r in index.apply(docs.unionByName(one)).collect()} == {2**53 + i: 2 if i % 3 < 2 else 1 for i in range(9)} | {2**53 + 9: 0}
    index.delete(one)
    assert {r.doc_id: r.n_dropped for r in index.apply(docs).collect()}[2**53 + 8] == 0


def test_quality_keeps_ids_and_categories(spark):
    """Ids beside a null one stay exact; superscripts and fractions are no letters, Roman numeral signs no capitals."""
    texts = ["² ½ ³ " * 12 + "²", "Ⅷ Ⅷa " * 12, "plain words that stand in a row of ten or more here", "- a\n- b c\n- d e\n- f g h\n- i j k l", "so it goes on...\nand so on and on…\nuntil here it ends"]
    rows = [(2**53 + 1, texts[0]), (None, texts[1]), *((i, t) for i, t in enumerate(texts[2:]))]
    got = {r.doc_id: r for r in quality.cascade(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2**53 + 1, None, 0, 1, 2}
    docs = {i: quality.base_figures(t)[0] for i, t in rows}
    assert quality._letters(docs[2**53 + 1]) and not quality._caps(docs[None]) and quality._bullets(docs[1]) and quality._dots(docs[2])
    assert {i: r.kept for i, r in got.items()} == {2**53 + 1: False, None: False, 0: True, 1: False, 2: False}
    with pytest.raises(ValueError):
        quality.cascade(spark.createDataFrame(rows, "kept long, text string"), keep=("kept",))


def test_pii_takes_the_best_first(spark):
    """In a chain A > B > C the last stays; nothing stands beside a longer one that holds it, however many there are."""
    cases = [
        ([(0, 10, 3), (8, 18, 2), (16, 26, 1)], [(0, 10), (16, 26)]),
        ([(0, 10, 1), (8, 18, 2), (16, 26, 1)], [(8, 18)]),
        ([(0, 100, 9), *((5 * i, 5 * i + 4, 1) for i in range(18))], [(0, 100)]),
        ([(0, 100, 1), *((5 * i, 5 * i + 4, 2) for i in range(18))], [(5 * i, 5 * i + 4) for i in range(18)]),
        ([(0, 10, 1), (8, 18, 1), (16, 26, 1), (30, 31, 1)], [(0, 10), (16, 26), (30, 31)]),
        ([], []),
    ]
    d = spark.createDataFrame([(i, [(s, e, str(r)) for s, e, r in c]) for i, (c, _) in enumerate(cases)], "i int, c array<struct<s:int,e:int,v:string>>")
    features, as_column = pii.features, pii.as_column
    try:
        pii.features, pii.as_column = (lambda c: F.array(c.v.cast("double"))), (lambda model, f: f[0])
        got = d.select("i", pii._choose(F.col("c"), None, 0.5).alias("k")).collect()
    finally:
        pii.features, pii.as_column = features, as_column
    assert [[(x.s, x.e) for x in r.k] for r in sorted(got)] == [want for _, want in cases]


def test_passages_among_near_misses(spark):
    """A 50-word passage of two documents is found though 240 others share 49 words of it, before or behind; ids may be text or null, a hot class and a hot seed included."""
    r = random.Random(7)
    w = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = w(50)
    docs = [(f"d{i}", " ".join(w(6) + passage + w(6)), 6) for i in (0, 1)]
    docs += [(f"x{i}", " ".join(w(8) + (passage[:49] if i % 2 else passage[1:]) + w(8)), None) for i in range(240)]
    copy = " ".join(w(60))
    docs += [(None, copy, 0)] * 30 + [(f"c{i}", copy, 0) for i in range(30)]
    got = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id string, text string, at int").repartition(5)).collect()
    where = {(x.doc_id, x.start, x.end) for x in got}
    near = {x for x in where if x[0] and x[0].startswith("x")}
    assert where - near == {("d0", 6, 56), ("d1", 6, 56), (None, 0, 60), *((f"c{i}", 0, 60) for i in range(30))}
    assert len(got) == 62 and not near


@pytest.mark.parametrize("rows", [2000, 3])
def test_mix_meets_the_flow(spark, monkeypatch, rows):
    """The search for the cut goes down as many levels as it needs; the words taken are those asked for, ties and null ids included."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", rows)
    monkeypatch.setattr(mixing, "BUCKET_BITS", 12 if rows > 3 else 3)
    docs = [(i if i % 7 else None, "w " * (i % 23), "abc"[i % 3] if i % 5 else None) for i in range(900)] + [(5, "same words here", "a")] * 40
    mixed, goal = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4))
    got = mixed.select(F.col("sources")[0].alias("s"), "size", "taken").collect()
    assert len(got) == len(docs) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for r in goal.collect():
        assert sum(x.taken for x in got if x.s == r.source) == round(r.target)
        assert sum(0 < x.taken % max(1, x["size"]) for x in got if x.s == r.source) <= 2


def test_letter_table(spark):
    letters = langid.Letters()
    letters.encode("".join(chr(0x4E00 + i) for i in range(3000)))
    assert letters.used == 3001 and len(letters.vectors) == 4096 and (np.abs(letters.vectors[:3001]) == 1).all()


def test_fit_sample_is_bounded_by_bytes(spark, monkeypatch):
    """Long texts make the samples smaller, not the driver's rows longer."""
    monkeypatch.setattr(toxicity, "FIT_BYTES", 20_000)
    rows = [(i, " ".join(f"w{(i * k) % 997}" for k in range(200)) + (" vile scorn" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.detect(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 400 and all(0 <= r.score <= 1 for r in got)
    n = toxicity._sample(spark.range(4000).withColumnRenamed("id", "doc_id"), 4000, 4000, "doc_id", 200_000).count()
    assert 300 < n < 500


@pytest.mark.parametrize("bad", ["<a x ", "<p ", "<title>", "<a x='", "<!", "<script ", "</p><div>", "<object></objectx>", "<svg></svg "])
def test_broken_pages_take_linear_time(bad):
    w = np.array(html_extract.fitted_weights())
    took = []
    for n in (1, 4):
        began = time.perf_counter()
        for tail in ("", '">"', "</x>" * 1000):
            html_extract.extract(bad * (n * 250_000 // len(bad)) + tail, w)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 and took[1] < 12 * took[0] + 1


def test_pages_without_article_elements():
    """Pages of two layouts against the lines they were made of."""
    r, w = random.Random(11), np.array(html_extract.fitted_weights())
    for i in range(60):
        say = lambda lo, hi: " ".join(f"w{r.randrange(10**5)}" for _ in range(r.randint(lo, hi)))
        lines = [say(15, 60) for _ in range(r.randint(2, 6))]
        menu = "<ul>" + "".join(f"<li><a href='/{k}'>{say(1, 2)}</a></li>" for k in range(r.randint(4, 9))) + "</ul>"
        inner = "".join(f"<p>{x}</p>" + ("<script>if (a < b) track('<p>x</p>')</script>" if r.random() < 0.3 else "") for x in lines)
        body = f"<div id='x{i}'>{inner}</div>" if i % 2 else f"<table><tr><td>{menu}</td><td>{inner}</td></tr></table>"
        page = f"<html><head><title>{say(1, 5)}</title></head><body><div class='nav'>{menu}</div>{body}<div class='footer'><p>{say(2, 6)}</p></div></body></html>"
        assert html_extract.extract(page, w) == "\n".join(lines)


def test_footer_longer_than_its_article():
    """Menus and footers beside an article stay out, however few words it has; without one, or within one, an element of most words is the text."""
    w, long = np.array(html_extract.fitted_weights()), "what the site says of itself in a great many words of small print, year after year"
    for tag in ("footer", "aside", "header"):
        for page in ("<article><h1>A b.</h1><p><b>A b.<br></article><{0}>{1}</{0}>", "<{0}>{1}</{0}><main><h1>A b.</h1><p>A b.</p></main>"):
            assert html_extract.extract(f"<html><body>{page.format(tag, long)}</body></html>", w) == "A b.\nA b."
        for page in ("<{0}>{1}</{0}>", "<article><{0}>{1}</{0}></article>", "<article></article><{0}>{1}</{0}>", "<{0}>{1}</{0}><div class='related'><article>A b.</article></div>"):
            assert long in html_extract.extract(f"<html><body>{page.format(tag, long)}</body></html>", w)


def test_contamination_in_groups(spark, sf, monkeypatch):
    """A benchmark searched in several groups gives what one group gives, with and without all postings; ids may be text or null."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.when(F.col("doc_id") % 50 != 0, F.concat(F.lit("d"), "doc_id")).alias("doc_id"), "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id or "", r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect())
    one = key(decontam.contamination(docs, items))
    assert sum(r[4] for r in one) > 0 and len(one) == docs.count()
    monkeypatch.setattr(decontam, "GROUP_WORDS", 5000)
    monkeypatch.setattr(decontam, "MOST_TERMS", 10)
    assert key(decontam.contamination(docs, items)) == one


def test_components_of_a_long_chain(spark):
    """The rounds go on until nothing changes, whatever the length of a chain."""
    n = 400
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 5, n + 9), (n + 9, n + 7)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, n)) and got[n + 9] == got[n + 7] == n + 5


def test_ngram_links_of_odd_ids(spark):
    """Text and null ids, repeated rows; sets whose first hash is the same stay apart."""
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    near = list(base)
    near[50] = "other"
    docs = [("b", " ".join(base)), ("a", " ".join(near)), ("a", " ".join(near)), (None, " ".join(base)), (None, "alone in here with these words"), ("c", None)]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    got = sorted(((r.doc_id or "", r.n_shingles, r.component_id) for r in ngram_join.join_components(d).collect()), key=str)
    assert got == sorted([("b", 97, "a"), ("a", 97, "a"), ("a", 97, "a"), ("", 97, "a"), ("", 3, None), ("c", 0, "c")], key=str)
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 2), (4, 8, 1)], "rid long, node long, check long").withColumn("n", F.lit(5).cast("long"))
    again, reps = ngram_join.known_classes(rows)
    assert {r.rid: r.node for r in again.collect()}[4] == 8 and again.select("node").distinct().count() == reps.count() == 3
