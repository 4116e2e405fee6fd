"""Queries over whole tables: every row counts, whatever its key or length."""
import collections
import hashlib
import html
import re
import sys
import unicodedata
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

import pytest
from compare import TABLES, oracle_rows, rows_of

from textloom import plans
from textloom.functions import unicode
from textloom.plans.dictionary import pairs_of

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


def same(spark, sf, name):
    cols, rows = rows_of(QUERIES[name](spark, sf))
    assert (cols, rows) == oracle_rows(ORACLES[name], sf)


@pytest.mark.parametrize("name, table, key, of", [("f33_spoken_orders", "orders", "o_orderkey", "o_orderkey"), ("j18_report_rows", "part", "chapter", "p_partkey")])
def test_every_key(spark, sf, name, table, key, of):
    assert table in TABLES
    got = sorted(r[0] for r in QUERIES[name](spark, sf).select(key).collect())
    assert got == sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(of).collect())
    same(spark, sf, name)


def test_every_reading(spark, sf):
    want = collections.defaultdict(set)
    for r in pairs_of(spark, sf).collect():
        want[r.book, r.base].add(r.reading)
    got = {(r.book, r.base): (r.kind, r.readings) for r in QUERIES["a5_distinct_readings"](spark, sf).collect()}
    assert got == {k: ("conflict" if len(v) > 1 else "replacement", ",".join(sorted(v))) for k, v in want.items()}
    same(spark, sf, "a5_distinct_readings")


def _texts(spark, sf, table, *cols):
    return spark.read.parquet(f"{sf}/{table}.parquet").select(*cols).collect()


def _md5(t):
    return None if t is None else hashlib.md5(t.encode()).hexdigest()


def test_whole_texts_replaced(spark, sf):
    want = {}
    for i, t in _texts(spark, sf, "documents", "doc_id", "text"):
        n = len(t)
        spans = sorted({(a, b) for a, b in ((2, 5), (40, 44), (300, 307)) if b <= n - 4} | ({(n - 4, n - 1)} if n >= 4 else set()), reverse=True)
        for a, b in spans:
            t = t[:a] + "<" + t[a:b] + ">" + t[b:]
        want[i] = (len(t), _md5(t))
    assert min(len(t) for _, t in _texts(spark, sf, "documents", "doc_id", "text")) < 60 and max(n for n, _ in want.values()) > 200
    assert {r.doc_id: (r.n, r.h) for r in QUERIES["f40_replace_spans"](spark, sf).collect()} == want


def test_whole_pages_marked(spark, sf):
    esc = lambda t: html.escape(t, quote=False).replace('"', "&quot;")
    want = {}
    for i, t in _texts(spark, sf, "pages", "page_id", "html"):
        out = f"<mark>{esc(t[:10])}</mark>{esc(t[10:20])}<mark>{esc(t[20:40])}</mark>{esc(t[40:])}"
        want[i] = (len(out), _md5(out))
    assert {r.page_id: (r.n, r.h) for r in QUERIES["f16_highlight"](spark, sf).collect()} == want


def test_whole_turns_joined(spark, sf):
    want, open_ = {}, {}
    for book, turn, role, text in sorted(_texts(spark, sf, "conversations", "conv_id", "turn", "role", "text")):
        if role == "user" or book not in open_:
            open_[book] = want[book, turn] = []
        open_[book].append(text)
    assert any(len(t) > 40 for x in want.values() for t in x)
    got = {(r.book, r.ord): (r.h, r.n) for r in QUERIES["w16_continuations"](spark, sf).collect()}
    assert got == {k: (_md5("\n\n".join(x)), len(x)) for k, x in want.items()}


def test_whole_texts_slugged(spark, sf):
    want = {i: re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).strip("-")[:60] or "chapter" for i, t in _texts(spark, sf, "documents", "doc_id", "text")}
    assert {r.doc_id: r.slug for r in QUERIES["f6_slug"](spark, sf).collect()} == want
    d = spark.createDataFrame([(1, "私" * 100 + " Letters follow")], "doc_id long, text string")
    assert d.select(unicode.slug("text")).first()[0] == "letters-follow"
