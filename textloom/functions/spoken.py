"""Numbers inside Japanese text as they are spoken: an ordered list of rewriting rules, in Arrow batches.

The order is the semantics: dates before times, fractions before counters, counters before bare numbers. Each rule is a
pattern and a function of its match that gives the replacement, or None to leave the text as it is.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.numerals import COUNTERS, DAYS, DIGIT_NAMES, IRREGULAR, KANA_DIGITS, KANA_GROUPS, KANA_HUNDREDS, KANA_TENS, KANA_THOUSANDS, KANJI_DIGITS, KANJI_GROUPS, KANJI_UNITS, KANJI_VALUES, MONTHS, ROMAN
from textloom.functions.unicode import compatible

_K = "〇零一二三四五六七八九十百千万億兆京"
_D = "〇零一二三四五六七八九"
_JA = "぀-ヿ㐀-䶿一-鿿々"
# Signs behind a counter that make it another word.
_NEXT_KEEPS = {"回": ("り",), "通": ("り",), "個": ("人",), "軒": ("家", "屋")}
# What follows 十分 in the sense of enough.
ENOUGH = ("に", "な", "だ", "です", "だった", "だっ", "だろ", "だろう", "でしょう", "である", "であ", "でな", "では", "でも", "じゃ", "じゃあ", "じゃない", "じゃなく", "なら", "ならば", "でいい", "でよ", "でよい", "かも", "かもし")
# What follows 十分 in the sense of ten minutes.
MINUTES = (
    "後", "前", "間", "ほど", "くらい", "ぐらい", "ばかり", "程度", "余り", "あまり", "以上", "以内", "経", "経っ", "経ち", "経て", "経る", "過", "過ぎ", "過ご", "待", "待っ", "歩", "走", "進", "続", "要", "要し", "かか", "かけ", "かっ", "かり",
    "だけ", "は", "も",
)
_CLOSING = tuple("。！？?!…」』】）］〉》”’\"'")


def kanji(n: int) -> str:
    if n == 0:
        return "零"
    out, g = "", 0
    while n and g < len(KANJI_GROUPS):
        part = "".join(("" if d == 1 and u else KANJI_DIGITS[d]) + KANJI_UNITS[u] for u in (3, 2, 1, 0) if (d := n % 10000 // 10**u % 10))
        out = (part + KANJI_GROUPS[g] if part else "") + out
        n, g = n // 10000, g + 1
    return out


def kana(n: int) -> str:
    if n == 0:
        return "ぜろ"
    out, g = "", 0
    while n and g < len(KANA_GROUPS):
        k = n % 10000
        part = KANA_THOUSANDS[k // 1000] + KANA_HUNDREDS[k // 100 % 10] + KANA_TENS[k // 10 % 10] + KANA_DIGITS[k % 10]
        out = (part + KANA_GROUPS[g] if part else "") + out
        n, g = n // 10000, g + 1
    return out


def digits(text: str) -> str:
    """Each digit by its name, ASCII or kanji."""
    return "".join(DIGIT_NAMES[KANJI_VALUES[c]] if c in _D else DIGIT_NAMES[int(c)] if c.isdigit() else c for c in text)


def number(text: str) -> int | None:
    """The value of ASCII digits or of a kanji numeral (see numerals.from_kanji)."""
    if text.isascii():
        bare = text.replace(",", "")
        return int(bare) if bare.isdigit() else None
    if all(c in _D for c in text):
        return int("".join(str(KANJI_VALUES[c]) for c in text))
    return sum(_pieces(text, "万億兆京", lambda x: sum(_pieces(x, "十百千", lambda y: KANJI_VALUES[y[-1]] if y else 0))))


def _pieces(text: str, units: str, value):
    """Values of the pieces that end with one of the units, each times its unit (once if it is empty), and of the rest."""
    for piece in re.split(f"(?<=[{units}])", text):
        if piece[-1:] and piece[-1] in units:
            yield (value(piece[:-1]) or 1) * KANJI_VALUES[piece[-1]]
        else:
            yield value(piece)


def written(text: str) -> str:
    """ASCII digits as a kanji number; very long ones and those with leading zeros digit by digit."""
    bare = text.replace(",", "")
    return digits(bare) if len(bare) > 16 or (len(bare) > 1 and bare[0] == "0") else kanji(int(bare))


def roman(text: str) -> int | None:
    values = dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True))
    n = sum(-values[a] if b and values[a] < values[b] else values[a] for a, b in zip(text, [*text[1:], ""], strict=True))
    canonical = 0 < n < 4000 and "".join(ROMAN[k][n // 10**k % 10] for k in (3, 2, 1, 0)) == text
    return n if canonical else None


def counted(n: int, counter: str) -> str:
    """A number with a counter: by the table of irregular readings, else number and counter."""
    return IRREGULAR.get(counter, {}).get(n) or kana(n) + COUNTERS[counter]


def _month(n):
    return MONTHS[n - 1] if n and 1 <= n <= 12 else None


def _day(n):
    return DAYS[n - 1] if n and 1 <= n <= 31 else None


def _date(m: re.Match) -> str | None:
    """Year in kanji; month and day by their readings, or in kanji if either has none."""
    g = m.groupdict()
    y, mo, d = (number(g[k]) if g.get(k) else None for k in "ymd")
    head = f"{kanji(y)}年" if y is not None else ""
    names = [_month(mo) if mo is not None else "", _day(d) if d is not None else ""]
    if None in names:
        names = [f"{kanji(mo)}月" if mo is not None else "", f"{kanji(d)}日" if d is not None else ""]
    return head + "".join(names)


def _slashed(m: re.Match) -> str | None:
    """A date, if month and day are such; addresses and the like are left alone."""
    return _date(m) if 1 <= int(m["m"]) <= 12 and 1 <= int(m["d"]) <= 31 else None


def _clock(m: re.Match) -> str:
    h, mi, s = (number(x) if x else None for x in (m["h"], m["mi"], m.groupdict().get("s")))
    minute = counted(mi, "分") if mi else "ぜろふん"
    return kana(h) + "じ" + minute + (kana(s) + "びょう" if s is not None else "")


def _is_enough(rest: str) -> bool:
    return not rest.startswith(MINUTES) and (not rest or rest.startswith(_CLOSING) or rest.startswith("だけ") < rest.startswith(ENOUGH))


def _counter(m: re.Match) -> str | None:
    """A number with its counter. Kanji numbers are read; of ASCII ones only those with a reading of their own, the others are written in kanji."""
    n, c, rest, before = number(m["n"]), m["c"], m.string[m.end() :], m.string[: m.start()][-1:]
    place = c == "代" and m["n"] == "千" and re.search(f"[{_JA}]", before + rest[:1])  # as in 千代田
    if n is None or place or rest.startswith(_NEXT_KEEPS.get(c, ())):
        return None
    readings = {
        "日間": (counted_days(n) + "かん") if c == "日間" else None,
        "分": kana(n) + "ぶん" if not m["n"].isascii() and n in (10, 12, 100) and _is_enough(rest) else None,
        "歳": "はたち" if n == 20 and rest[:1] not in ("代", "台") else None,
        "人": counted(n, "人"),
    }
    if own := readings.get("歳" if c == "才" else c):
        return own
    if c in ("歳", "才") and n == 20:
        return written(m["n"]) + c if m["n"].isascii() else kana(n) + COUNTERS[c]
    return counted(n, c) if n in IRREGULAR.get(c, {}) or not m["n"].isascii() else written(m["n"]) + c


def counted_days(n: int) -> str:
    return "いちにち" if n == 1 else _day(n) or kana(n) + "にち"


def _keep(prefix: str = "", suffix: str = ""):
    return lambda m: prefix + written(m["n"]) + suffix


_C = "|".join(sorted([*map(re.escape, COUNTERS), "日間"], key=len, reverse=True))
_N, _Kn = r"(?<!\d)", f"[{_K}]+"
#: Pattern, function, and signs one of which each match has; none: any text may match.
RULES: list[tuple[str, object, str]] = [
    (r"(?<=\d)\s*[~〜～]\s*(?=\d)", lambda m: "から", "~〜～"),
    (f"(?<=[{_K}])\\s*[~〜～]\\s*(?=[{_K}])", lambda m: "から", "~〜～"),
    (_N + r"(?P<y>\d{2,4})年(?P<m>\d{1,2})月(?:(?P<d>\d{1,2})日)?", _date, "年"),
    (_N + r"(?P<m>\d{1,2})月(?P<d>\d{1,2})日", _date, "月"),
    (f"(?P<y>{_Kn})年(?P<m>{_Kn})月(?:(?P<d>{_Kn})日)?", _date, "年"),
    (f"(?P<n>[{_D}]{{2,}})年", lambda m: kanji(number(m["n"])) + "年", "年"),
    (f"(?P<m>{_Kn})月(?P<d>{_Kn})日", _date, "月"),
    (f"(?P<d>[{_D}]{{2,}})日(?![間])", lambda m: kana(number(m["d"])) + "にち", "日"),
    (f"(?P<m>{_Kn})月", lambda m: _month(number(m["m"])), "月"),
    (_N + r"(?P<y>\d{1,4})[/-](?P<m>\d{1,2})[/-](?P<d>\d{1,2})(?!\d)", _slashed, "/-"),
    (r"(?<![\d/])(?P<m>\d{1,2})[/-](?P<d>\d{1,2})(?=\s*[(（][日月火水木金土](?:曜日?)?[)）])", _date, "(（"),
    (_N + r"(?P<a>\d+)[/／](?P<b>\d+)(?!\d)", lambda m: f"{kana(int(m['b']))}ぶんの{kana(int(m['a']))}" if int(m["b"]) else None, "/／"),
    (f"(?P<a>\\d+|{_Kn})分の(?P<b>\\d+|{_Kn})", lambda m: f"{kana(number(m['a']))}ぶんの{kana(number(m['b']))}", "分"),
    (_N + r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2}))?(?!\d)", _clock, ":"),
    (f"(?P<h>{_Kn})時(?P<mi>{_Kn})分(?:(?P<s>{_Kn})秒)?", _clock, "時"),
    (_N + r"(?P<n>\d+)(?:\.(?P<f>\d+))?[%％]", lambda m: written(m["n"]) + (f"てん{digits(m['f'])}" if m["f"] else "") + "パーセント", "%％"),
    (f"(?P<n>{_Kn})(?:[%％]|パーセント)", lambda m: kanji(number(m["n"])) + "パーセント", "%％パ"),
    (_N + r"(?P<n>\d+)\.(?P<f>\d+)(?!\d)", lambda m: f"{written(m['n'])}てん{digits(m['f'])}", "."),
    (f"(?P<n>{_Kn})[.．](?P<f>[{_D}]+)", lambda m: kanji(number(m["n"])) + "てん" + digits(m["f"]).replace("ゼロ", "ぜろ"), ".．"),
    (f"(?P<n>\\d+)(?P<c>{_C})", _counter, ""),
    (f"(?P<n>{_Kn})(?P<c>{_C})", _counter, ""),
    (r"第(?P<n>\d+)", _keep("第"), "第"),
    (r"[A-Za-z]+(?P<n>\d+)[A-Za-z]*", lambda m: m[0][: m.start("n") - m.start()] + digits(m["n"]) + m[0][m.end("n") - m.start() :], ""),
    (f"[{_D}]{{2,}}", lambda m: kanji(number(m[0])), ""),
    (f"[{_D}](?:[、，,・][{_D}])+", lambda m: digits(m[0]), "、，,・"),
    (r"\A(?P<a>\s*)(?P<n>\d+)(?P<b>\s*)\Z", lambda m: m["a"] + written(m["n"]) + m["b"], ""),
    (f"(?<![0-9A-Za-z{_JA}])(?P<n>\\d+)(?![0-9A-Za-z{_JA}])", lambda m: digits(m["n"]), ""),
    (r"\d+", lambda m: written(m[0]), ""),
]
#: With each rule also whether its matches have digits, kanji numerals, or either.
_RULES = [(re.compile(p), f, signs, r"\d" in p, _K in p or _D in p) for p, f, signs in RULES]
_DIGIT, _NUMERAL = re.compile(r"\d"), re.compile(f"[{_K}]")
_ROMAN_GLYPHS, _ROMAN_LETTERS = re.compile("[Ⅰ-ⅿ]+"), re.compile("(?<![A-Za-z])[IVXLCDM]{2,}(?![A-Za-z])")


def speak(text: str | None) -> str | None:
    """The text with its numbers rewritten."""
    if not text:
        return text

    def value(m: re.Match, most: int) -> str:
        n = roman(unicodedata.normalize("NFKC", m[0]).upper())
        return m[0] if n is None or n > most else kana(n)

    t = _ROMAN_LETTERS.sub(lambda m: value(m, 50), _ROMAN_GLYPHS.sub(lambda m: value(m, 3999), text))
    t = compatible(t)
    digit, numeral = _DIGIT.search(t), _NUMERAL.search(t)
    for pattern, rule, signs, of_digits, of_numerals in _RULES:
        if (of_digits and digit or of_numerals and numeral) and (not signs or any(c in t for c in signs)):
            before, t = t, pattern.sub(lambda m, r=rule: m[0] if (x := r(m)) is None else x, t)
            if t != before:
                digit, numeral = _DIGIT.search(t), _NUMERAL.search(t)
    return t


@F.pandas_udf(StringType())
def speak_numbers(s: pd.Series) -> pd.Series:
    return s.map(speak)
