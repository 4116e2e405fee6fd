"""Small helpers on one text each, for operators/tracking.py: numbered markers around spans, and what an edit replaced."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

from textloom.functions.text import KANA, KANJI, to_hiragana_map

#: Private-use signs: before and behind a span's number, and its ten digits, so that rules about digits don't meet them.
OPEN, CLOSE, DIGITS = "\ue010", "\ue011", "".join(map(chr, range(0xE020, 0xE02A)))
RESERVED = f"[{OPEN}{CLOSE}{DIGITS}]"
HELD = re.compile(RESERVED)
#: Anchors are whole pieces of a text: a run up to and with a mark or a line break.
_PIECE = re.compile(r"[^\n。．！？!?.、,]*[\n。．！？!?.、,]+|[^\n。．！？!?.、,]+")
_TOKEN = re.compile(f"([{OPEN}{CLOSE}])([{DIGITS}]+)[{OPEN}{CLOSE}]")
_TO_OWN, _TO_PLAIN = str.maketrans("0123456789", DIGITS), str.maketrans(DIGITS, "0123456789")
#: Pieces of a text whose lengths have a larger product are first cut at the runs of characters that occur once on both sides.
PRODUCT, GRAMS = 1 << 20, (48, 24, 12)
#: Lengths of the pieces that a longest match is looked for by, and of the runs of a common subsequence that a text without anchors is cut at.
SEEDS, RUNS = (24, 8, 4, 2, 1), (12, 4, 1)
#: Bits of a table of a common subsequence that are kept at once.
BITS = 1 << 28
_KANJI, _KANA = (re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{m[1]:0>8}", f"[{c}]")) for c in (KANJI, KANA))
_RUNS = re.compile(f"({_KANA.pattern}+)")


def apart(text: str, spans: Iterable[tuple[int, int, str | None, str]]) -> list[tuple[int, int, str, str]]:
    """Of spans (start, end, base, reading) in order those that fit the text and start at or behind the end of the last one taken; an empty base is read from the text."""
    out, at = [], 0
    for start, end, base, reading in sorted((s, e, b or text[s:e], r) for s, e, b, r in spans if 0 <= s < e <= len(text) and r.strip(" ")):
        if start >= at and text[start:end] == base:
            out.append((start, end, base, reading))
            at = end
    return out


def mark(text: str, spans, reading: bool) -> str:
    """The text with each span (start, end, base, reading; sorted, apart) between two markers that bear its number; base or reading stands between them."""
    out, at = [], 0
    for i, (start, end, base, said) in enumerate(spans):
        number = str(i).translate(_TO_OWN)
        out += (text[at:start], f"{OPEN}{number}{OPEN}", said if reading else base, f"{CLOSE}{number}{CLOSE}")
        at = end
    return "".join([*out, text[at:]])


def unmark(text: str) -> tuple[str, dict[int, tuple[int, int]]]:
    """The text without markers, and where what stood between the two of a number now stands; numbers that lost one are left out."""
    out, opened, found, size, at = [], {}, {}, 0, 0
    for m in _TOKEN.finditer(text):
        out.append(text[at : m.start()])
        size, at = size + m.start() - at, m.end()
        number = int(m[2].translate(_TO_PLAIN))
        if m[1] == OPEN:
            opened.setdefault(number, size)
        elif number in opened:
            found[number] = (opened.pop(number), size)
    return "".join([*out, text[at:]]), found


def gaps(a: str, b: str) -> Iterator[tuple[int, str, str]]:
    """What differs between anchors, in time of the texts: (place in a, part of a, part of b), with something on both sides.

    Anchors are pieces that occur once on both sides, and whose order agrees with all others before and behind them.
    """
    sides = [_PIECE.findall(x) for x in (a, b)]
    once = [{p: i for i, p in enumerate(pieces) if counts[p] == 1} for pieces, counts in ((x, Counter(x)) for x in sides)]
    both = [(i, once[1][p]) for p, i in once[0].items() if p in once[1]]  # in the order of a
    before = accumulate((j for _, j in both), max, initial=-1)
    behind = [*accumulate((j for _, j in reversed(both)), min)][::-1][1:] + [len(sides[1])]
    anchors = [x for x, most, least in zip(both, before, behind, strict=False) if most < x[1] < least]
    at = x0 = y0 = 0
    for x, y in [*anchors, (len(sides[0]), len(sides[1]))]:
        plain, ruby = "".join(sides[0][x0:x]), "".join(sides[1][y0:y])
        if plain and ruby and plain != ruby:
            yield at, plain, ruby
        at += len(plain) + (len(sides[0][x]) if x < len(sides[0]) else 0)
        x0, y0 = x + 1, y + 1


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by the first place, whose second places rise too."""
    ends, last, before = [], [], [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before[i] = last[k - 1] if k else -1
        ends[k : k + 1], last[k : k + 1] = [j], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _once(text: str, k: int) -> dict[str, int]:
    """The k-grams that occur once, with their place."""
    seen: dict[str, int] = {}
    for i in range(len(text) - k + 1):
        g = text[i : i + k]
        seen[g] = -1 if g in seen else i
    return {g: i for g, i in seen.items() if i >= 0}


def _diagonals(a: str, b: str, a0: int, a1: int, b0: int, b1: int, k: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the matches of k signs or more between a[a0:a1] and b[b0:b1], each as long as it goes."""
    places: dict[str, list[int]] = {}
    for j in range(b0, b1 - k + 1):
        places.setdefault(b[j : j + k], []).append(j)
    out, runs = [], {}  # runs: where a match that goes on began, by the place in b of its last piece
    for i in range(a0, a1 - k + 1):
        js = places.get(a[i : i + k])
        if js or runs:
            now = {j: runs.pop(j - 1, i) for j in js or ()}
            out += [(x, j - (i - 1 - x), i - 1 - x + k) for j, x in runs.items()]
            runs = now
    return out + [(x, j - (a1 - k - x), a1 - k - x + k) for j, x in runs.items()]


def _blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """The matching blocks of difflib.SequenceMatcher(None, a, b, autojunk=False): the longest match, the first of equals, then those before and behind it.

    Matches are looked for by pieces of k signs, and by shorter ones where there is none. They are found once for each k: what lies before and behind the longest one has parts of the same.
    """
    out, todo = [], [(0, len(a), 0, len(b), 0, [])]
    while todo:
        a0, a1, b0, b1, level, found = todo.pop()
        if not found and set(a[a0:a1]).isdisjoint(b[b0:b1]):
            continue
        while not found and level < len(SEEDS):
            if SEEDS[level] <= min(a1 - a0, b1 - b0):
                found = _diagonals(a, b, a0, a1, b0, b1, SEEDS[level])
            level += 1
        i, j, n = min(found, key=lambda m: (-m[2], m[0], m[1]))
        out.append((i, j, n))
        for x0, x1, y0, y1 in ((a0, i, b0, j), (i + n, a1, j + n, b1)):
            if x0 < x1 and y0 < y1:
                k = SEEDS[level - 1]
                cut = ((x, y, max(x0 - x, y0 - y, 0), min(x1 - x, y1 - y, m)) for x, y, m in found)
                todo.append((x0, x1, y0, y1, level, [(x + s, y + s, e - s) for x, y, s, e in cut if e - s >= k]))
    return sorted(out)


def _rows(a: str, b: str) -> Iterator[int]:
    """For each head of a the table's row as bits: a bit of b's signs is unset where the longest common subsequence grows."""
    masks: dict[str, int] = {}
    for c in set(b) & set(a):
        masks[c] = int("".join("1" if x == c else "0" for x in reversed(b)), 2)
    full = row = (1 << len(b)) - 1
    for c in a:
        if c in masks:
            u = row & masks[c]
            row = ((row + u) | (row - u)) & full
        yield row


def _sizes(a: str, b: str) -> list[int]:
    """The size of the longest common subsequence of a and each head of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    return [0, *accumulate(x == "0" for x in reversed(f"{row:0{len(b)}b}"))] if b else [0]


def _common(a: str, b: str, i: int = 0, j: int = 0) -> Iterator[tuple[int, int]]:
    """Places of a longest common subsequence, in time of the product over the bits of a word; a table too large to keep is halved first."""
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > BITS:
        h = len(a) // 2
        sums = [x + y for x, y in zip(_sizes(a[:h], b), reversed(_sizes(a[h:][::-1], b[::-1])), strict=True)]
        k = sums.index(max(sums))
        yield from _common(a[:h], b[:k], i, j)
        yield from _common(a[h:], b[k:], i + h, j + k)
        return
    rows, out = list(_rows(a, b)), []
    x, y = len(a) - 1, len(b) - 1
    while x >= 0 and y >= 0:
        if rows[x] >> y & 1:
            y -= 1  # the size is the same without this sign of b
        elif x and not rows[x - 1] >> y & 1:
            x -= 1  # and without this one of a
        else:
            out.append((i + x, j + y))
            x, y = x - 1, y - 1
    yield from reversed(out)


def _runs(a: str, b: str) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the runs of a longest common subsequence that are long; shorter ones where there is none."""
    found: list[list[int]] = []
    for x, y in _common(a, b):
        if found and found[-1][0] + found[-1][2] == x and found[-1][1] + found[-1][2] == y:
            found[-1][2] += 1
        else:
            found.append([x, y, 1])
    return next(filter(None, ([tuple(r) for r in found if r[2] >= k] for k in RUNS)), [])


def replacements(a: str, b: str, i: int = 0, j: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(start, end) in a and in b of what b has in place of a. Long texts are cut at anchors, so that time is about in proportion to them; where nothing occurs once, at the runs of a longest common subsequence."""
    if len(a) * len(b) > PRODUCT:
        for k in GRAMS:
            there = _once(b, k)
            chain = _chain([(x, there[g]) for g, x in _once(a, k).items() if g in there])
            if chain:
                x0 = y0 = 0
                for x, y in [*chain, (len(a), len(b))]:
                    if x >= x0 and y >= y0:  # the chain's k-grams may overlap: what lies between two of them is compared
                        if x > x0 or y > y0:
                            yield from replacements(a[x0:x], b[y0:y], i + x0, j + y0)
                        x0, y0 = x + k, y + k
                    elif x - x0 == y - y0:  # the same run goes on
                        x0, y0 = x + k, y + k
                return
        x0 = y0 = 0
        for x, y, n in [*_runs(a, b), (len(a), len(b), 0)]:
            if x - x0 == len(a) and y - y0 == len(b):  # nothing in common
                yield i, i + x, j, j + y
            elif x > x0 and y > y0:
                yield from replacements(a[x0:x], b[y0:y], i + x0, j + y0)
            x0, y0 = x + n, y + n
        return
    x0 = y0 = 0
    for x, y, n in [*_blocks(a, b), (len(a), len(b), 0)]:
        if x > x0 and y > y0:
            yield i + x0, i + x, j + y0, j + y
        x0, y0 = x + n, y + n


def split_on_kana(start: int, base: str, reading: str) -> list[tuple[int, int, str, str]]:
    """(start, end, base, reading) of the parts of a base that kana of its own divide; whole, if it doesn't mix kanji and kana.

    The kana must stand in the reading, in order; what lies between them belongs to the signs between. The regular expression's
    backtracking finds the split whose leading parts are longest; without one, there is no span. Parts without kanji get none.
    """
    if not (_KANJI.search(base) and _KANA.search(base)):
        return [(start, start + len(base), base, reading)]
    parts = [p for p in _RUNS.split(base) if p]
    kana = [bool(_KANA.match(p)) for p in parts]
    form = "".join(re.escape(p.translate(to_hiragana_map())) if k else "(.+)" for p, k in zip(parts, kana, strict=True))
    got = re.fullmatch((".*" if kana[0] else "") + form, unicodedata.normalize("NFKC", reading).translate(to_hiragana_map()), re.S)
    if not got:
        return []
    out, at, group = [], start, 0
    for p, k in zip(parts, kana, strict=True):
        if not k:
            group += 1
            if _KANJI.search(p):
                out.append((at, at + len(p), p, got[group]))
        at += len(p)
    return out
