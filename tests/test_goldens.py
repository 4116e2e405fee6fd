"""Results written out by hand from the rules."""

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1])]

from pyspark.sql import functions as F

from textloom.functions import html
from textloom.functions import text as T
from textloom.functions.spoken import speak
from textloom.operators import joins as J

#: (text, script, hiragana, katakana, tail, spaces, waves, ellipsis, pause)
JAPANESE = [
    ('漢字', 'kanji', '漢字', '漢字', '漢字。', '漢字', '漢字', '漢字', 0),
    ('カナ', 'katakana', 'かな', 'カナ', 'カナ。', 'カナ', 'カナ', 'カナ', 0),
    ('ひらカタ', 'kana', 'ひらかた', 'ヒラカタ', 'ひらカタ。', 'ひらカタ', 'ひらカタ', 'ひらカタ', 0),
    ('東京 大阪', 'mixed', '東京 大阪', '東京 大阪', '東京 大阪。', '東京。大阪', '東京 大阪', '東京 大阪', 0),
    ('今日 は 雨', 'mixed', '今日 は 雨', '今日 ハ 雨', '今日 は 雨。', '今日、は、雨', '今日 は 雨', '今日 は 雨', 0),
    ('10〜20人', 'mixed', '10〜20人', '10〜20人', '10〜20人。', '10〜20人', '10から20人', '10〜20人', 0),
    ('あ〜ん', 'mixed', 'あ〜ん', 'ア〜ン', 'あ〜ん。', 'あ〜ん', 'あーん', 'あ〜ん', 0),
    ('行く。」', 'mixed', '行く。」', '行ク。」', '行く。」', '行く。」', '行く。」', '行く。」', 0),
    ('…………', 'other', '…………', '…………', '…………', '…………', '…………', '⋯', 740),
    ('「……」', 'other', '「……」', '「……」', '「……」', '「……」', '「……」', '「……」', 500),
    ('abc', 'other', 'abc', 'abc', 'abc', 'abc', 'abc', 'abc', 0),
    ('そうか？', 'mixed', 'そうか？', 'ソウカ？', 'そうか？', 'そうか？', 'そうか？', 'そうか？', 0),
]
#: (line, heading, repaired)
CAPITALS = [
    ('CHAPTER FIRST', True, 'Chapter First'),
    ('CHAPTER FIRST', False, 'Chapter first'),
    ('THE HOUSE OF NASA AND LONDON IV', False, 'The house of NASA and London IV'),
    ('Not Capitals', True, 'Not Capitals'),
    ('12 - 13', False, '12 - 13'),
]
#: (style sheet, markers)
CSS = [
    ('h1.Title { a: b } .body{} #hd-1, p.midashi2 > a.ttl {x:y} /* .chapter {} */', '.title|#hd-1|.midashi2|.ttl'),
    ('p { }', ''),
    ('', ''),
]
#: (page, link, target)
HREFS = [
    ('text/a.xhtml', 'b.xhtml#x', 'text/b.xhtml'),
    ('text/a.xhtml', '../img/c%20d.png', 'img/c d.png'),
    ('a.xhtml', './x+y.html', 'x+y.html'),
    ('t/a.xhtml', '#top', 't/a.xhtml'),
    ('t/u/a.xhtml', '/k/../z.html', 'z.html'),
    ('a.xhtml', '100%.html', '100%.html'),
]
#: (text, spoken)
SPOKEN = [
    ('2024年7月1日', '二千二十四年しちがつついたち'),
    ('四月', 'しがつ'),
    ('七月一五日', 'しちがつじゅうごにち'),
    ('八月一〇日', 'はちがつとおか'),
    ('二〇一〇年三月', '二千十年さんがつ'),
    ('一二時五九分〇二秒', 'じゅうにじごじゅうきゅうふんにびょう'),
    ('一〇〇パーセント', '百パーセント'),
    ('三〇年', '三十年'),
    ('二〇日ほど経つ', 'にじゅうにちほど経つ'),
    ('二．〇', '二てんぜろ'),
    ('3.14', '三てんいちよん'),
    ('合計13です', '合計十三です'),
    ('10', '十'),
    (' 11 ', ' 十一 '),
    ('番号 10', '番号 いちゼロ'),
    ('全7冊 合本版', '全ななさつ 合本版'),
    ('20歳を過ぎた', 'はたちを過ぎた'),
    ('一人で二人と4人', 'ひとりでふたりとよにん'),
    ('二日間の旅', 'ふつかかんの旅'),
    ('一日間滞在', 'いちにちかん滞在'),
    ('三杯', 'さんばい'),
    ('十分待つ', 'じゅっぷん待つ'),
    ('十分に注意する', 'じゅうぶんに注意する'),
    ('一個人の判断', '一個人の判断'),
    ('三分の二', 'さんぶんのに'),
    ('10分の1', 'じゅうぶんのいち'),
    ('2/3(日)開催', 'にがつみっか(日)開催'),
    ('HG 1/144 スサノオ', 'HG ひゃくよんじゅうよんぶんのいち スサノオ'),
    ('GOSICK VIII 上', 'GOSICK はち 上'),
    ('TV CM', 'TV CM'),
    ('平日10:00～18:00まで', '平日じゅうじぜろふんからじゅうはちじぜろふんまで'),
    ('下心１００％だぜ', '下心百パーセントだぜ'),
    ('ver.1.0', 'ver.一てんゼロ'),
]
#: (html, text, ruby)
RUBY = [
    ("<p>前<ruby>漢字<rt>かんじ</rt></ruby>後</p>", "前漢字後", "1:3:漢字:かんじ"),
    ("<p><ruby>漢字<rp>(</rp><rt>かんじ</rt><rp>)</rp></ruby>です。</p>", "漢字です。", "0:2:漢字:かんじ"),
    ("<img alt='第一章 はじまり'><p>文。</p>", "第一章 はじまり\n文。", ""),
    ("<p>a<sup>1</sup></p><hr/><p>b</p>", "a\n\ue000\nb", ""),
]


def test_japanese(spark):
    t = F.col("t")
    rows = spark.createDataFrame([r[:1] for r in JAPANESE], "t string")
    got = rows.select("t", T.script(t), T.to_hiragana(t), T.to_katakana(t), T.tail_stop(t), T.space_to_pause(t), T.wave_dashes(t), T.short_ellipsis(t), T.ellipsis_pause(t)).collect()
    assert sorted(map(tuple, got)) == sorted(JAPANESE)


def test_capitals(spark):
    known = F.create_map(F.lit("nasa"), F.lit("NASA"), F.lit("london"), F.lit("London"))
    rows = spark.createDataFrame([r[:2] for r in CAPITALS], "line string, heading boolean")
    assert sorted(map(tuple, rows.select("line", "heading", T.repair_capitals(F.col("line"), F.col("heading"), known)).collect())) == sorted(CAPITALS)


def test_css(spark):
    rows = spark.createDataFrame([r[:1] for r in CSS], "css string")
    assert sorted(map(tuple, rows.select("css", F.array_join(T.css_markers(F.col("css")), "|")).collect())) == sorted(CSS)


def test_hrefs(spark):
    rows = spark.createDataFrame([r[:2] for r in HREFS], "base string, href string")
    assert sorted(map(tuple, rows.select("base", "href", J.resolve_href(F.col("base"), F.col("href"))).collect())) == sorted(HREFS)


def test_spoken():
    assert [speak(t) for t, _ in SPOKEN] == [s for _, s in SPOKEN]


def test_ruby():
    for raw, text, ruby in RUBY:
        got = html.read_html(raw)
        assert (got["text"], ",".join(f"{r['start']}:{r['end']}:{r['base']}:{r['reading']}" for r in got["ruby"])) == (text, ruby)
