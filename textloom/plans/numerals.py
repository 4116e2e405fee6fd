"""Queries of the numeral functions over keys, sizes, dates and durations of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import numerals as N
from textloom.functions.spoken import speak_numbers
from textloom.plans.common import literal_rows, table

#: Texts and how their numbers are spoken.
SPOKEN = [
    ("2024年7月1日", "二千二十四年しちがつついたち"), ("四月", "しがつ"), ("七月一五日", "しちがつじゅうごにち"), ("八月一〇日", "はちがつとおか"), ("二〇一〇年三月", "二千十年さんがつ"), ("一二時五九分〇二秒", "じゅうにじごじゅうきゅうふんにびょう"), ("一〇〇パーセント", "百パーセント"), ("三〇年", "三十年"), ("二〇日ほど経つ", "にじゅうにちほど経つ"), ("二．〇", "二てんぜろ"), ("3.14", "三てんいちよん"), ("合計13です", "合計十三です"), ("10", "十"), (" 11 ", " 十一 "), ("番号 10", "番号 いちゼロ"), ("全7冊 合本版", "全ななさつ 合本版"), ("20歳を過ぎた", "はたちを過ぎた"), ("一人で二人と4人", "ひとりでふたりとよにん"), ("二日間の旅", "ふつかかんの旅"), ("一日間滞在", "いちにちかん滞在"), ("三杯", "さんばい"), ("十分待つ", "じゅっぷん待つ"), ("十分に注意する", "じゅうぶんに注意する"), ("一個人の判断", "一個人の判断"), ("三分の二", "さんぶんのに"), ("10分の1", "じゅうぶんのいち"), ("2/3(日)開催", "にがつみっか(日)開催"), ("HG 1/144 スサノオ", "HG ひゃくよんじゅうよんぶんのいち スサノオ"), ("GOSICK VIII 上", "GOSICK はち 上"), ("TV CM", "TV CM"), ("平日10:00～18:00まで", "平日じゅうじぜろふんからじゅうはちじぜろふんまで"), ("下心１００％だぜ", "下心百パーセントだぜ"), ("ver.1.0", "ver.一てんゼロ"),
]


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _kanji(n: str) -> str:
    """SQL for 0 <= n < 10^8, by list lookups."""

    def group(g: str) -> str:
        parts = [f"CASE ({g}) // {10**k} % 10 WHEN 0 THEN '' WHEN 1 THEN '{N.KANJI_UNITS[k]}' ELSE {_list(N.KANJI_DIGITS)}[({g}) // {10**k} % 10 + 1] || '{N.KANJI_UNITS[k]}' END" for k in (3, 2, 1)]
        return " || ".join([*parts, f"{_list(N.KANJI_DIGITS)}[({g}) % 10 + 1]"])

    return f"CASE WHEN ({n}) = 0 THEN '零' ELSE (CASE WHEN ({n}) >= 10000 THEN {group(f'({n}) // 10000')} || '万' ELSE '' END) || {group(f'({n}) % 10000')} END"


def _kana(n: str) -> str:
    def group(g: str) -> str:
        return f"{_list(N.KANA_THOUSANDS)}[({g}) // 1000 % 10 + 1] || {_list(N.KANA_HUNDREDS)}[({g}) // 100 % 10 + 1] || {_list(N.KANA_TENS)}[({g}) // 10 % 10 + 1] || {_list(N.KANA_DIGITS)}[({g}) % 10 + 1]"

    return f"CASE WHEN ({n}) = 0 THEN 'ぜろ' ELSE (CASE WHEN ({n}) >= 10000 THEN {group(f'({n}) // 10000')} || 'まん' ELSE '' END) || {group(f'({n}) % 10000')} END"


def q_kanji(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.to_kanji(F.col("o_orderkey")).alias("kanji"), N.to_kanji(F.floor("o_totalprice")).alias("price"))


def q_kana(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.to_kana(F.col("o_orderkey")).alias("kana"), N.to_kana(F.floor("o_totalprice")).alias("price"))


def q_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.date_reading(F.col("o_orderdate")).alias("reading"))


def q_roman(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.to_roman(F.col("o_orderkey")).alias("roman"))


def q_digits(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.digit_names(F.col("c_name")).alias("spoken"))


def q_from_kanji(spark, sf):
    """Numbers written in kanji and read again."""
    return table(spark, sf, "orders").select("o_orderkey", N.from_kanji(N.to_kanji(F.col("o_orderkey"))).alias("value"), N.from_kanji(F.translate((F.col("o_orderkey") % 1000).cast("string"), "0123456789", "〇一二三四五六七八九")).alias("digits"))


def q_timecode(spark, sf):
    code = F.concat_ws(":", F.lpad((F.col("l_orderkey") % 24).cast("string"), 2, "0"), (F.col("l_partkey") % 60).cast("string"), F.concat((F.col("l_suppkey") % 60).cast("string"), F.lit(".5")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", N.timecode_ms(F.when(F.col("l_linenumber") == 7, "bad").otherwise(code)).alias("ms"))


def q_clock(spark, sf):
    t = F.when(F.col("p_size") < 10, F.col("p_size").cast("string")).when(F.col("p_size") < 30, F.concat_ws(":", (F.col("p_partkey") % 70).cast("string"), (F.col("p_size") * 3).cast("string"))).otherwise(F.concat(F.lit("1:"), (F.col("p_partkey") % 60).cast("string"), F.lit(":02.25")))
    return table(spark, sf, "part").select("p_partkey", N.clock_seconds(t).alias("seconds"))


def q_part_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.part_name(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".m4b"), F.col("p_size"), F.col("p_partkey")).alias("name"))


def q_gain(spark, sf):
    a, p = -(F.abs("s_acctbal") % 40), -(F.abs("s_acctbal") % 7)
    return table(spark, sf, "supplier").select("s_suppkey", F.round(N.gain_db(a, p), 6).alias("gain"))


_COUNTED = ("回", "冊", "分", "本", "杯", "軒", "歳", "点", "枚", "人")


def q_counters(spark, sf):
    """Quantities with counters, by the kind of part."""
    p = table(spark, sf, "part").withColumn("n", F.col("p_size") % 24 + 1).withColumn("k", (F.col("p_partkey") % len(_COUNTED)).cast("int"))
    out = F
    for i, c in enumerate(_COUNTED):
        out = out.when(F.col("k") == i, N.counted(F.col("n"), c))
    return p.select("p_partkey", "n", F.array(*map(F.lit, _COUNTED))[F.col("k")].alias("counter"), out.alias("reading"))


def q_spoken(spark, sf):
    """Days of all orders written with digits, and texts with numbers of every kind (without a key), read out."""
    days = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy年M月d日").alias("t"))
    texts = literal_rows(spark, {"t": "string"}, [r[:1] for r in SPOKEN]).select(F.lit(None).cast(days.schema["o_orderkey"].dataType).alias("o_orderkey"), "t")
    return days.unionByName(texts).withColumn("spoken", speak_numbers("t"))


def _spoken(o):
    """Orders in words: the day, and the price with a counter."""
    text = F.concat(F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("に"), F.floor("o_totalprice").cast("string"), F.lit("円"))
    return o.select("o_orderkey", speak_numbers(text).alias("spoken"))


def q_spoken_orders(spark, sf):
    return _spoken(table(spark, sf, "orders"))


QUERIES = {
    "f31_to_kana": q_kana, "f31_to_kanji": q_kanji, "f31_digit_names": q_digits, "f32_from_kanji": q_from_kanji, "f32_to_roman": q_roman, "f33_spoken": q_spoken, "f33_spoken_orders": q_spoken_orders, "f34_date_reading": q_dates, "f35_counters": q_counters, "f36_clock_seconds": q_clock, "f36_timecode": q_timecode, "f37_gain": q_gain, "f52_part_name": q_part_name,
}

_PRICE = "CAST(floor(o_totalprice) AS BIGINT)"
_DIGITS = "c_name"
for _d, _name in enumerate(N.DIGIT_NAMES):
    _DIGITS = f"replace({_DIGITS}, '{_d}', '{_name}')"

#: Irregular readings written out, for the comparison only.
_IRREGULAR = (
    "回 1 いっかい, 回 6 ろっかい, 回 8 はっかい, 回 10 じゅっかい, 冊 1 いっさつ, 冊 8 はっさつ, 冊 10 じゅっさつ, 分 1 いっぷん, 分 3 さんぷん, 分 4 よんぷん, 分 6 ろっぷん, 分 8 はっぷん, 分 10 じゅっぷん, 本 1 いっぽん, 本 3 さんぼん, 本 6 ろっぽん, 本 8 はっぽん, "
    "本 10 じゅっぽん, 杯 1 いっぱい, 杯 3 さんばい, 杯 6 ろっぱい, 杯 8 はっぱい, 杯 10 じゅっぱい, 軒 1 いっけん, 軒 3 さんげん, 軒 6 ろっけん, 軒 8 はっけん, 軒 10 じゅっけん, 歳 1 いっさい, 歳 8 はっさい, 歳 10 じゅっさい, 歳 20 はたち, 点 1 いってん, 人 1 ひとり, 人 2 ふたり, 人 4 よにん"
)
_NAMES = ("かい", "さつ", "ふん", "ほん", "はい", "けん", "さい", "てん", "まい", "にん")

ORACLES = {
    "f33_spoken": f"SELECT o_orderkey, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS t, {_kanji('year(o_orderdate)')} || '年' || {_list(N.MONTHS)}[month(o_orderdate)] || {_list(N.DAYS)}[day(o_orderdate)] AS spoken FROM orders UNION ALL SELECT NULL, t, spoken FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SPOKEN) + ") AS v(t, spoken)",
    "f33_spoken_orders": f"SELECT o_orderkey, {_kanji('year(o_orderdate)')} || '年' || {_list(N.MONTHS)}[month(o_orderdate)] || {_list(N.DAYS)}[day(o_orderdate)] || 'に' || {_kana(_PRICE)} || 'えん' AS spoken FROM orders",
    "f35_counters": f"""WITH p AS (SELECT p_partkey, p_size % 24 + 1 AS n, CAST(p_partkey % 10 + 1 AS INT) AS k FROM part), q AS (SELECT *, {_list(_COUNTED)}[k] AS counter, {_list(_NAMES)}[k] AS name FROM p),
i AS (SELECT * FROM (VALUES {", ".join("('{}', {}, '{}')".format(*x.split()) for x in _IRREGULAR.split(", "))}) AS v(counter, n, r)) SELECT p_partkey, q.n, q.counter, coalesce(r, {_kana('q.n')} || name) AS reading FROM q LEFT JOIN i ON i.counter = q.counter AND i.n = q.n""",
    "f31_to_kana": f"SELECT o_orderkey, {_kana('o_orderkey')} AS kana, {_kana(_PRICE)} AS price FROM orders",
    "f31_to_kanji": f"SELECT o_orderkey, {_kanji('o_orderkey')} AS kanji, {_kanji(_PRICE)} AS price FROM orders",
    "f31_digit_names": f"SELECT c_custkey, {_DIGITS} AS spoken FROM customer",
    "f32_from_kanji": "SELECT o_orderkey, o_orderkey AS value, o_orderkey % 1000 AS digits FROM orders",
    "f32_to_roman": "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 1 AND 3999 THEN " + " || ".join(f"{_list(N.ROMAN[k])}[o_orderkey // {10**k} % 10 + 1]" for k in (3, 2, 1, 0)) + " ELSE '' END AS roman FROM orders",
    "f34_date_reading": f"SELECT o_orderkey, {_kanji('year(o_orderdate)')} || '年' || {_list(N.MONTHS)}[month(o_orderdate)] || {_list(N.DAYS)}[day(o_orderdate)] AS reading FROM orders",
    "f36_clock_seconds": """SELECT p_partkey, CASE WHEN p_size < 10 THEN CAST(p_size AS DOUBLE) WHEN p_size < 30 THEN CASE WHEN p_size * 3 < 60 THEN CAST(p_partkey % 70 * 60 + p_size * 3 AS DOUBLE) END ELSE 3600 + p_partkey % 60 * 60 + 2.25 END AS seconds FROM part""",
    "f36_timecode": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 0 ELSE (l_orderkey % 24 * 3600 + l_partkey % 60 * 60 + l_suppkey % 60) * 1000 + 500 END AS ms FROM lineitem",
    "f37_gain": """SELECT s_suppkey, round(CASE WHEN abs(least(-20 + abs(s_acctbal) % 40, -1 + abs(s_acctbal) % 7)) < 0.05 THEN 0 ELSE least(-20 + abs(s_acctbal) % 40, -1 + abs(s_acctbal) % 7) END, 6) AS gain FROM supplier""",
    "f52_part_name": "SELECT p_partkey, replace(p_name, ' ', '-') || '.part' || CASE WHEN greatest(2, length(CAST(p_partkey AS VARCHAR))) > length(CAST(p_size AS VARCHAR)) THEN lpad(CAST(p_size AS VARCHAR), CAST(greatest(2, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') ELSE CAST(p_size AS VARCHAR) END || '.m4b' AS name FROM part",
}
