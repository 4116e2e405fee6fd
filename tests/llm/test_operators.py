"""Edge cases and interfaces of the operators."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parents[2])]
from textloom.llm import decontam, html_extract, langid, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node string, kept string, seed int, items string, pattern string, bucket string, n string, `__text` string"
REST = ("x", 1, 0.5, 3, "n", "k", 1, "i", "p", "b", "n", "t")


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, 0.5, 3, "n", "k", 1, "i", "p", "b", "n", "t")


LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
RUN = "a" * 200_000 + " " + "1" * 100_000 + " " + "9." * 20_000
ROWS = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "ärger 漢字 😀 x@y.de"), row(None, "no id but some words here"), row(5, LONG), row(6, LONG), row(6, LONG), row(7, RUN), row(8, "short one", None, None), row(8, "short one", None, None), row(9, "y " * 30_000, "", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, None), (8, None, 1), (8, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def both(spark, odd, none, run):
    """The operator runs on odd rows, one result per row, and gives nothing for none."""
    assert run(none).count() == 0
    got = run(odd).collect()
    assert len(got) == len(ROWS)
    return got


def test_pii(spark, odd, none):
    got = both(spark, odd, none, pii.find)
    by = {r.doc_id: r for r in got}
    assert [(x.s, x.e) for x in by[4].email_base] == [(11, 17)]
    assert by[1].email_base == by[1].card_added == []
    cases = {"mail joe [at] example.com": "mail <email>", "phone 415-555-1234 ok": "phone <phone> ok", "Amex card 3782 822463 10005": "Amex card <card>", "order 12345678": "order 12345678", "host 2001:db8::ff00:42:8329": "host <ip>", "10.0.0.256": "10.0.0.256", "a@b.c%d@e.f": "<email><email>"}
    d = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r.redacted for r in pii.redact(d).orderBy("doc_id").collect()] == list(cases.values())
    many = spark.createDataFrame([(1, "é 1.2.3.4 " * 1000)], "doc_id long, text string")
    assert [(x.s, x.e) for x in pii.find(many).first().ip_base] == [(10 * i + 2, 10 * i + 9) for i in range(1000)]


def test_boosting():
    r = np.random.default_rng(0)
    x = r.integers(0, 5, (600, 4)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 2] < 3)).astype(float)
    m = pii.boost(x, y)
    assert ((pii.tree_scores(m, x) > 0) == (y > 0)).all()
    assert pii.threshold_for(np.array([3.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0]), 0.99) == pytest.approx(2.0, abs=1e-5)
    assert pii.threshold_for(np.zeros(0), np.zeros(0), 0.9) > 0


def test_suffixes(spark, odd, none):
    assert suffix_dedup.repeats(none).count() == 0
    got = {(r.doc_id, r.start, r.end) for r in suffix_dedup.repeats(odd).collect()}
    assert got == {(5, 0, 60_000), (6, 0, 60_000)}


def test_planted_passages(spark):
    r = random.Random(1)
    w = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = [w(n) for n in (50, 49, 51, 64, 90, 200)]
    docs, want = [], {}
    for i, p in enumerate(shared):
        for k in range(3):
            head = w(r.randrange(40))
            docs.append((10 * i + k, " ".join(head + p + w(20))))
            if len(p) >= 50:
                want[10 * i + k] = (len(head), len(head) + len(p))
    docs += [(1000 + i, " ".join(w(120))) for i in range(20)]
    got = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.start, x.end) for x in got} == want and len(got) == len(want)


def test_mixing(spark, odd, none):
    assert mixing.mix(none)[0].count() == 0
    mixed, goal = mixing.mix(odd, extra=("text", "lang", "n"))
    rows = mixed.collect()
    assert len(rows) == len(ROWS) and all(0 <= r[3] <= 2 * r[2] for r in rows)
    assert {r.source for r in goal.collect()} == {"a", None, ""}


def test_flow():
    got = mixing.min_cost_flow({"x": 100, "xy": 50}, {"x": ["x"], "xy": ["x", "y"]}, {"x": 120, "y": 60}, 2)
    used = {}
    for (p, s, i), n in got.items():
        used[p, i] = used.get((p, i), 0) + n
    assert sum(got.values()) == 180 and used["x", 0] == 100 and used["xy", 0] == 50
    assert sum(n for (_, _, i), n in got.items() if i) == 30
    assert mixing.water_fill(10, {"a": 1, "b": 1}, {"a": 2, "b": 100}) == {"a": 2.0, "b": 8.0}


def test_overlapping_sources(spark):
    d = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)], "doc_id long, text string, s array<string>")
    mixed, goal = mixing.mix(d, sources=F.col("s"), weights=(1,), share=1.0)
    assert mixed.agg(F.sum("taken")).first()[0] == pytest.approx(sum(r.target for r in goal.collect()), abs=2)


def test_language(spark, odd, none):
    assert {r.lang_pred for r in langid.identify(odd, train=F.col("doc_id") < 0).collect()} == {"und"}
    got = both(spark, odd, none, langid.identify)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    one = langid.Letters()
    k, n = langid.grams_of(one, "ab " * 1000)
    assert n.sum() == 2000 and len(k) == 2
    size, langid.CHUNK_CHARS = langid.CHUNK_CHARS, 7
    try:
        k2, n2 = langid.grams_of(one, "ab " * 1000)
    finally:
        langid.CHUNK_CHARS = size
    assert k.tolist() == k2.tolist() and n.tolist() == n2.tolist()


def test_lines(spark, odd, none):
    got = both(spark, odd, none, line_dedup.dedup_lines)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_lines, by[1].n_dropped, by[1].kept) == (1, 0, "")
    assert by[5].n_dropped == by[6].n_dropped == 0  # three rows, but two documents, hold the line


def test_line_paths(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = sorted(line_dedup.dedup_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(line_dedup.dedup_lines(docs).collect()) == small


def test_line_index(spark):
    text = lambda *xs: "\n".join(f"line number {x} of the text" for x in xs)
    docs = spark.createDataFrame([(1, text(1, 2)), (2, text(1, 2, 3)), (3, text(1, 3)), (4, text(1))], "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=3)
    index.insert(docs.filter("doc_id < 3"))
    assert all(r.n_dropped == 0 for r in index.apply(docs).collect())
    index.insert(docs.filter("doc_id >= 3"))
    assert {r.doc_id: r.kept for r in index.apply(docs).collect()} == {1: text(2), 2: text(2, 3), 3: text(3), 4: text(1)}
    index.delete(docs.filter("doc_id IN (3, 4)"))
    assert {r.doc_id: r.kept for r in index.apply(docs).collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_cuckoo():
    r = np.random.default_rng(2)
    keys = r.integers(0, 2**63, (5000, 2), dtype=np.int64)
    f = line_dedup.CuckooFilter.build(keys[:, 0], keys[:, 1])
    assert f.holds(keys[:, 0], keys[:, 1]).all()
    other = r.integers(0, 2**63, (5000, 2), dtype=np.int64)
    assert f.holds(other[:, 0], other[:, 1]).mean() < 0.01
    for a, b in keys[:2500].tolist():
        assert f.delete(a, b)
    g = line_dedup.CuckooFilter.load(f.dump())
    assert g.holds(keys[2500:, 0], keys[2500:, 1]).all() and g.holds(keys[:2500, 0], keys[:2500, 1]).mean() < 0.01


def test_pages(spark):
    w = np.array(html_extract.fitted_weights())
    body = "<p>One long paragraph of the article, with <a href='x'>a link</a> &amp; more words than that.</p>"
    page = f"<html><head><title>T</title><script>var a = '<p>x</p>'</script></head><body><div id='menu'><ul><li><a href='/'>Home</a></li><li><a>About us</a></li></ul></div><div class='post'><h1>Head</h1>{body}<div class='ad-box ads'>Buy now</div><form>Your mail<input></form>{body}</div><div class='comments'><p>Nice text, I like it very much indeed.</p></div><footer>(c) me</footer></body></html>"
    para = "One long paragraph of the article, with a link & more words than that."
    assert html_extract.extract(page, w) == f"Head\n{para}\n{para}"
    assert html_extract.extract(None, w) == html_extract.extract("", w) == html_extract.extract("<div></div>", w) == ""
    assert html_extract.best_region(np.array([-1.0, 2.0, -1.0, 3.0, -5.0])) == (1, 4) and html_extract.best_region(np.zeros(0)) == (0, 0)
    d = spark.createDataFrame([(None, None, None, "t"), (1, "u", page, "t"), (1, "u", page, "t"), (2, "u", "<p " * 20000, "t"), (3, "u", "<p>x " * 20000, "t")], "page_id long, url string, html string, text string")
    got = html_extract.main_text(d).collect()
    assert len(got) == 5 and got[0].text == "" and len(got[4].text) == 2 * 20000 - 1
    assert html_extract.main_text(d.limit(0)).count() == 0


def test_quality(spark, odd, none):
    got = both(spark, odd, none, quality.cascade)
    by = {r.doc_id: r for r in got}
    assert by[1].base_failed and not by[1].kept and by[1].n_words == 0
    assert by[9].n_words == by[9].n_repeat_words == 30_000
    assert quality.repeat_words(list("abcdexabcde")) == 10 and quality.repeat_words(list("aaaaaa")) == 6 and quality.repeat_words(list("abcde")) == 0
    ticks = iter(range(1000))
    cheap = quality.Rule("cheap", lambda d: d.n_words > 1)
    idle = quality.Rule("idle", lambda d: False)
    docs = [quality.base_figures(t)[0] for t in ("a", "a b", "a b c")]
    assert [r.name for r, _, _ in quality.order_rules((idle, cheap), docs, lambda: next(ticks))] == ["cheap", "idle"]


def test_toxicity(spark, odd, none, labels):
    got = both(spark, odd, none, lambda d: toxicity.detect(d, labels))
    assert all(0 <= r.score <= 1 for r in got)
    got = toxicity.detect(odd, labels.limit(0)).collect()
    assert all(r.score < 0.3 and r.predicted == 0 for r in got)


def test_nnpu():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda bad: " ".join(r.choices(words, k=60) + (["vile", "scorn"] if bad else []))
    enc = toxicity.Encoder()
    pos = [np.sort(enc(text(True))) for _ in range(100)]
    free = [np.sort(enc(text(i % 10 == 0))) for i in range(600)]
    w, b = toxicity.fit_nnpu(pos, free, 0.1)
    good, bad = ([enc(text(x)) for _ in range(100)] for x in (False, True))
    assert (toxicity._raw(bad, w, b) > 0).mean() > 0.95 and (toxicity._raw(good, w, b) > 0).mean() < 0.05


def test_ngrams(spark, odd, none):
    got = both(spark, odd, none, ngram_join.join_components)
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == 1 and by[1].n_shingles == 0 and by[6].component_id == 5 and by[2].component_id == 2
    assert by[None].component_id is None


def test_near_copies(spark):
    """A group of near copies around a template, chains, and texts just under the threshold, against brute force."""
    r = random.Random(5)
    w = lambda n: [f"w{r.randrange(10**5)}" for _ in range(n)]
    docs, template = [], w(120)
    for i in range(60):
        t = list(template)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        docs.append(t)
    chain = w(100)
    for i in range(12):
        docs.append(chain[i * 4 :] + w(i * 4))
    docs += [w(r.randrange(1, 40)) for _ in range(40)] + [w(5)] * 3
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    sets = [{tuple(t[i : i + 4]) for i in range(max(1, len(t) - 3))} for t in docs]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if v == y else v for v in root]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(root))


def test_contamination(spark, odd, none):
    items = spark.createDataFrame([(1, "short one"), (1, "short one"), (2, None), (3, " "), (None, "no id but"), (10, "words here")], "item_id long, text string")
    got = both(spark, odd, none, lambda d: decontam.contamination(d, items))
    by = {r.doc_id: r for r in got}
    assert (by[8].n_hit, by[8]["items"], by[8].contaminated) == (2, ["1"], True)
    assert (by[None].n_hit, by[None]["items"]) == (5, ["10"]) and by[1].n_words == 0 and not by[1].contaminated
    assert all(r.n_hit == 0 for r in decontam.contamination(odd, items.limit(0)).collect())


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "f x x x x x x a"), (3, "c a")], "doc_id long, text string")
    index = decontam.build_index(d, block_tokens=8)
    near = decontam.proximity(index, {"q": ("c", "a")}, 2).collect()
    assert {r.doc_id for r in near} == {1, 3}
    assert {r.doc_id: r.n_hit for r in decontam.search(index, {("b", "c"): ["1"]}).collect()} == {1: 2, 2: 0, 3: 0}
