"""HTML to text with ruby spans and headings, by an event parser in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

SECTION = "\ue000"
SKIPPED = frozenset("script style nav header footer aside noscript rp sup title".split())
BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tr td th figure figcaption body html".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NOTE = re.compile(r"(?:^|[\s_-])(?:footnote|endnote|copyright|credit)s?(?:$|[\s_-])", re.I)
_NOTE_ID = re.compile(r"^fn[-_]?\d+$", re.I)


def struct_of(**fields: Ty.DataType) -> Ty.StructType:
    return Ty.StructType([Ty.StructField(k, t) for k, t in fields.items()])


STRING, _I = Ty.StringType(), Ty.IntegerType()
RUBY = Ty.ArrayType(struct_of(start=_I, end=_I, base=STRING, reading=STRING))
_TYPES = struct_of(text=STRING, ruby=RUBY, headings=Ty.ArrayType(struct_of(level=_I, text=STRING)))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.size = 0
        self.skip: list[str] = []
        self.ruby: list[tuple[int, int, str]] = []
        self.base_at: int | None = None
        self.reading: list[str] | None = None
        self.readings: list[str] = []
        self.heads: list[tuple[int, str]] = []
        self.head: tuple[int, int] | None = None

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def _break(self) -> None:
        if self.size and not self.out[-1].endswith("\n"):
            self._add("\n")

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in SKIPPED or _NOTE.search(a.get("class", "")) or _NOTE_ID.search(a.get("id", "")) or "noteref" in a.get("epub:type", ""):
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag == "br":
            self._add("\n")
        elif tag == "hr":
            self._break()
            self._add(f"{SECTION}\n")
        elif tag == "img" and a.get("alt", "").strip():
            self._add(a["alt"].strip())
        elif tag in BLOCKS:
            self._break()
            if re.fullmatch("h[1-6]", tag):
                self.head = (int(tag[1]), self.size)
        elif tag == "ruby":
            self.base_at, self.readings = self.size, []
        elif tag == "rt":
            self.reading = []

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
            return
        if tag == "rt" and self.reading is not None:
            self.readings.append("".join(self.reading))
            self.reading = None
        elif tag == "ruby" and self.base_at is not None:
            reading = re.sub(r"\s+", "", "".join(self.readings))
            if reading and self.size > self.base_at:
                self.ruby.append((self.base_at, self.size, reading))
            self.base_at = None
        elif tag in BLOCKS:
            if self.head and re.fullmatch("h[1-6]", tag):
                text = re.sub(r"\s+", " ", "".join(self.out)[self.head[1] :]).strip()
                if text and len(text) <= 120:
                    self.heads.append((self.head[0], text))
                self.head = None
            self._break()

    def handle_data(self, data):
        if self.skip:
            return
        if self.reading is not None:
            self.reading.append(data)
            return
        text = re.sub(r"[ \t\r\n\f]+", " ", data)
        if text.startswith(" ") and (not self.size or self.out[-1].endswith(("\n", " "))):
            text = text[1:]
        if text:
            self._add(text)


def read_html(raw: str | None) -> dict:
    """text, its ruby spans and its headings (h1 first, then h2 ..., in document order within a level)."""
    r = _Reader()
    r.feed(raw or "")
    r.close()
    whole = "".join(r.out)
    lead = len(whole) - len(whole.lstrip())
    text = whole.strip()
    ruby = [{"start": a - lead, "end": b - lead, "base": whole[a:b], "reading": x} for a, b, x in r.ruby]
    return {"text": text, "ruby": ruby, "headings": [{"level": k, "text": t} for k, t in sorted(r.heads, key=lambda h: h[0])]}


class _Marking(_Reader):
    """Also keeps the places of what notes are made of: elements with an id, links with their labels, and note bodies, whose ids count though they aren't read."""

    def __init__(self):
        super().__init__()
        self.marks: list[tuple[str, str, int, int, str]] = []
        self.open: list[tuple[str, str, str, int]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        note = "footnote" in (a.get("epub:type"), a.get("role", "").removeprefix("doc-")) or (tag in NOTE_BODIES and (re.search("footnote|endnote", a.get("class", ""), re.I) or a.get("id", "").lower().startswith(("fn", "footnote", "endnote"))))
        if note and a.get("id"):
            self.marks.append(("note", a["id"], self.size, self.size, ""))
        super().handle_starttag(tag, attrs)
        if not self.skip and tag not in VOID:
            kind, name = ("link", a.get("href", "")) if tag == "a" else ("id", a.get("id", ""))
            self.open.append((tag, kind, name, self.size))
            if tag == "a" and a.get("id"):
                self.marks.append(("id", a["id"], self.size, self.size, ""))

    def handle_endtag(self, tag):
        skipped = bool(self.skip)
        super().handle_endtag(tag)
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if skipped or at is None:
            return
        for _, kind, name, start in self.open[at:]:
            if name:
                self.marks.append((kind, name, start, self.size, "".join(self.out)[start:].strip() if kind == "link" and self.size - start <= 240 else ""))
        del self.open[at:]


NOTE_BODIES = frozenset("p section div aside ol ul li td".split())
_MARKS = struct_of(text=STRING, ruby=RUBY, headings=Ty.ArrayType(struct_of(level=_I, text=STRING)), marks=Ty.ArrayType(struct_of(kind=STRING, id=STRING, start=_I, end=_I, label=STRING)))


def read_page(raw: str | None) -> dict:
    """As read_html, with marks (kind: note, id or link; id or href; start, end, label), whose places are those of the text."""
    r = _Marking()
    r.feed(raw or "")
    r.close()
    whole = "".join(r.out)
    lead, size = len(whole) - len(whole.lstrip()), len(whole.strip())
    place = lambda x: min(max(x - lead, 0), size)
    ruby = [{"start": a - lead, "end": b - lead, "base": whole[a:b], "reading": x} for a, b, x in r.ruby]
    marks = [{"kind": k, "id": i, "start": place(a), "end": place(b), "label": t} for k, i, a, b, t in r.marks]
    return {"text": whole.strip(), "ruby": ruby, "headings": [{"level": k, "text": t} for k, t in sorted(r.heads, key=lambda h: h[0])], "marks": marks}


@F.pandas_udf(_MARKS)
def html_page(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Struct of text, ruby, headings and marks of an HTML column."""
    for s in batches:
        yield pd.DataFrame([read_page(x) for x in s], columns=["text", "ruby", "headings", "marks"])


@F.pandas_udf(struct_of(text=STRING, ruby=RUBY))
def without_ranges(texts: pd.Series, rubies: pd.Series, cuts: pd.Series) -> pd.DataFrame:
    """A text without ranges (start, end; sorted, apart), stripped, and its ruby spans moved along; those that lost a sign go."""
    out = []
    for text, ruby, ranges in zip(texts, rubies, cuts, strict=True):
        ranges = [] if ranges is None else [(r["start"], r["end"]) for r in ranges]
        kept, at = [], 0
        for a, b in [*ranges, (len(text), len(text))]:
            kept.append(text[at:a])
            at = b
        whole = "".join(kept)
        lead = len(whole) - len(whole.lstrip())
        ends, gone, total = [b for _, b in ranges], [0], 0
        for a, b in ranges:
            total += b - a
            gone.append(total)
        moved = []
        for r in ruby:
            i = bisect_right(ends, r["start"])
            if i == len(ranges) or ranges[i][0] >= r["end"]:
                moved.append({**r, "start": r["start"] - gone[i] - lead, "end": r["end"] - gone[i] - lead})
        out.append((whole.strip(), moved))
    return pd.DataFrame(out, columns=["text", "ruby"])


@F.pandas_udf(_TYPES)
def html_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Struct of text, ruby and headings of an HTML column."""
    for s in batches:
        yield pd.DataFrame([read_html(x) for x in s], columns=["text", "ruby", "headings"])
