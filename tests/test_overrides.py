"""Reading overrides on the odd rows: modes, order, patterns that don't compile, null texts, empty tables."""
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))

import pytest
from pyspark.sql import functions as F

from textloom.operators import overrides as O

ENTRY = "book string, ord int, base string, pattern string, reading string, mode string"


def applied(spark, text, entries):
    texts = spark.createDataFrame([("a", 1, text)], "book string, id int, text string")
    rows = spark.createDataFrame([("a", i, *e) for i, e in enumerate(entries)], ENTRY)
    return O.apply_overrides(texts, rows, ["book"]).first().text


CASES = [
    ("帝は山へ。帝国の帝だ", [("帝", None, "ミカド", "isolated")], "ミカドは山へ。帝国のミカドだ"),
    ("小さな家、小は", [("小", None, "ショウ", "isolated")], "小さな家、ショウは"),
    ("その帝だ。大帝だ。帝です", [("帝", None, "ミカド", "isolated")], "そのミカドだ。大帝だ。帝です"),
    ("この山と山々、登山", [("山", None, "やま", "kanji")], "このやまと山々、登山"),
    ("東京都と東京", [("東京", None, "とうきょう", None), ("東京都", None, "とうきょうと", None)], "とうきょうと" + "と" + "とうきょう"),
    ("東京と東京", [("東京", None, "とう$1\\", "first")], "とう$1\\と東京"),
    ("a.b a+b", [("a+b", None, "x", "isolated"), ("a", None, "$0", "isolated")], "$0.b x"),
    ("１２巻と３巻", [(None, "([０-９])巻", r"\1かん", None), (None, "(", "!", None), (None, "と", r"\9", None)], "１２かんと３かん"),
    ("", [("a", None, "b", None)], ""),
    (None, [("a", None, "b", None), (None, "a", "b", None)], None),
    ("a", [("a", None, "", None), ("", None, "b", None), (None, None, "b", None)], "a"),
    ("a", [], "a"),
]


@pytest.mark.parametrize("text, entries, want", CASES)
def test_apply(spark, text, entries, want):
    assert applied(spark, text, entries) == want


def test_apply_to_other_groups_and_repeated_rows(spark):
    texts = spark.createDataFrame([("a", "xx"), ("a", "xx"), ("b", "xx"), (None, "xx")], "book string, text string")
    rows = spark.createDataFrame([("a", 0, "x", None, "y", None), ("c", 0, "x", None, "z", None)], ENTRY)
    assert sorted(r.text for r in O.apply_overrides(texts, rows, ["book"]).collect()) == ["xx", "xx", "yy", "yy"]
    assert O.apply_overrides(texts.limit(0), rows, ["book"]).collect() == []


def test_surfaces(spark):
    texts = spark.createDataFrame([(1, "ab cd" + " " * 100 + "ef"), (2, "xyz")], "chapter int, text string")
    tokens = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 5, 5), (1, 60, 107), (2, 5, 9)], "chapter int, start int, end int")
    spans = spark.createDataFrame([(1, 0, 1, 4), (1, 1, 50, 61), (1, 2, 10, 12), (1, 3, 106, 108), (2, 4, 0, 2), (2, 5, 2, 2)], "chapter int, id int, start int, end int")
    assert {r.id: r.surface for r in O.surfaces(texts, spans, tokens).collect()} == {0: "ab cd", 1: "ef", 2: "", 3: "", 4: "xy", 5: ""}


def test_comments(spark):
    one = lambda text, *comments: spark.range(1).select(O.add_comments(F.lit(text), F.array(*map(F.lit, comments))).alias("t")).first().t
    assert one(None, "a", "a=b") == "# a\n# a=b"
    assert one("x＝y\n\n\n", "x=y") == "x＝y"
    assert one("# a\r\nb\tc  ", "a", "b=c", " d ", "") == "# a\nb\tc\n\n# d"
