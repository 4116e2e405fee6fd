"""Fixtures of segmentation, numbers, files and streams."""
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))

import io
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import numerals, unicode
from textloom.functions.segment import SECTION, chunk_spans
from textloom.operators import analytics, dictionary
from textloom.sources import files

CHUNKS = [
    ("私は、猫です。\n次の行です。", 100, 0, ["私は、猫です。", "次の行です。"]),
    (f"一。\n\n{SECTION}\n\n二。", 100, 0, ["一。", "二。"]),
    ("１\n\n本文です。", 100, 0, ["１", "本文です。"]),
    ("さくら荘のペットな彼女　全13巻", 100, 0, ["さくら荘のペットな彼女", "全13巻"]),
    ("一。二。三。四。", 4, 0, ["一。二。", "三。四。"]),
    ("第一章\n\n1\n\n九月十日、火曜日の放課後。\n\nコトリと頭上で音がした。", 0, 12, ["第一章\n\n1\n\n九月十日、火曜日の放課後。", "コトリと頭上で音がした。"]),
    ("彼は「いいえ。ありがとうございます」と言った。", 100, 0, ["彼は", "「いいえ。ありがとうございます」", "と言った。"]),
    ("彼は、「はい」と言った。", 220, 0, ["彼は、", "「はい」", "と言った。"]),
    ("医師の口にした「念のため」にさまざまな解釈をくわえた。", 220, 0, ["医師の口にした「念のため」にさまざまな解釈をくわえた。"]),
    ("「夢みたいなことをね。ちょっと」\n\n病院だったんだ。昼過ぎだったんだ。", 220, 0, ["「夢みたいなことをね。ちょっと」", "病院だったんだ。昼過ぎだったんだ。"]),
    ("「あいうえお。かきくけこ。さしすせそ。」", 10, 0, ["「あいうえお。", "かきくけこ。", "さしすせそ。」"]),
    ("「……」\n\n「空太？」", 100, 0, ["「……」", "「空太？」"]),
    ("", 100, 0, []),
    (None, 100, 0, []),
]


@pytest.mark.parametrize("text, most, least, want", CHUNKS)
def test_chunks(text, most, least, want):
    assert [text[a:b] for a, b in chunk_spans(text, most, least)] == want


def test_large_numbers(spark):
    d = spark.createDataFrame([(0,), (1000,), (10010,), (123456789012,), (9 * 10**18,)], "n long")
    got = d.select(numerals.to_kanji(F.col("n")).alias("k"), numerals.from_kanji(numerals.to_kanji(F.col("n"))).alias("v"), "n").collect()
    assert [r.k for r in got] == ["零", "千", "一万十", "千二百三十四億五千六百七十八万九千十二", "九百京"]
    assert [r.v for r in got] == [r.n for r in got]


def test_unicode(spark):
    d = spark.createDataFrame([("ＡＢＣ…１", "Éxämple! One"), (None, "漢字")], "a string, b string")
    got = d.select(unicode.nfkc("a").alias("a"), unicode.slug("b").alias("b")).collect()
    assert [tuple(r) for r in got] == [("ABC…1", "example-one"), (None, "chapter")]


@pytest.mark.parametrize("durations, parts, want", [([1000, 2000, 3000, 4000], 2, [1, 1, 2, 2]), ([1, 1, 1], 3, [1, 1, 1]), ([5], 4, [1]), ([10, 1, 1, 1], 2, [1, 2, 2, 2])])
def test_split(spark, durations, parts, want):
    rows = [(1, i, d, parts) for i, d in enumerate(durations)]
    got = analytics.split_parts(spark.createDataFrame(rows, "book int, chapter int, duration_ms long, parts int")).orderBy("chapter").collect()
    assert [r.part for r in got] == want


def test_boundary_report(spark):
    rows = [("gapless", True, 1.0, d, 20.0, 280) for d in (10.0, 12.0, 14.0, 16.0, 18.0)] + [("ended", True, 1.0, 999.0, 20.0, 280)]
    d = spark.createDataFrame(rows, "trigger string, preloaded boolean, playback_rate double, delta_ms double, output_latency_ms double, pad_ms long")
    r = analytics.boundary_report(d, 5).first()
    assert (r.samples_filtered, r.coverage, r.recommended, r.basis) == (5, 1.0, 34, "p50(delta_ms + output_latency_ms)")
    r = analytics.boundary_report(d.limit(0), 5).first()
    assert (r.samples_total, r.samples_filtered, r.coverage, r.recommended) == (0, 0, 0.0, None)


def test_context_pattern(spark):
    d = spark.createDataFrame([("上手", "上手"), ("上手", "上手い"), ("上手", "お上手"), ("a", "xaya")], "b string, s string")
    assert [r.p for r in d.select(dictionary.context_pattern(F.col("b"), F.col("s")).alias("p")).collect()] == ["", "上手(?=い)", "(?<=お)上手", ""]


def _epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        z.writestr("OEBPS/book.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:date>c. 1999-01</dc:date></metadata>'
                   '<manifest><item id="c1" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="img" href="x.png" media-type="image/png"/><item id="cov" href="y.png" media-type="image/png" properties="cover-image"/></manifest><spine><itemref idref="c1"/></spine></package>')  # fmt: skip
        z.writestr("OEBPS/a b.xhtml", "<p>x</p>")
        z.writestr("OEBPS/x.png", b"12345")
        z.writestr("OEBPS/y.png", b"1")
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(_epub())
    items = files.read_epub(spark, str(tmp_path))
    assert items.filter("spine_ord = 0").first().href == "OEBPS/a b.xhtml"
    meta = files.book_metadata(items).first()
    assert (meta.title, meta.authors, meta.year) == ("T", ["A", "B"], "1999")
    assert files.cover_items(items).first().item_id == "cov"
    (tmp_path / "01_my-book.txt").write_text("text “a”\r\nx", encoding="utf-8")
    (tmp_path / "two.txt").write_text("\n# Head\nbody", encoding="utf-8")
    assert sorted(r.title for r in files.read_texts(spark, str(tmp_path / "*.txt")).collect()) == ["Head", "my book"]
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\n[1]\nbroken\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in files.read_jsonl(spark, str(tmp_path / "log.jsonl"), "a long, b string").collect()) == [(1, "x"), (2, None)]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<800h", *[0] * 800))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    assert sorted((r.duration_ms, r.valid) for r in files.read_wav_info(spark, str(tmp_path)).collect()) == [(0, False), (100, True)]
    files.append_jsonl(spark.createDataFrame([(1,)], "a long"), str(tmp_path / "out"))
    files.append_jsonl(spark.createDataFrame([(2,)], "a long"), str(tmp_path / "out"))
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "out"), "a long").collect()) == [1, 2]
