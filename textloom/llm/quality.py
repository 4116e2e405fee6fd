"""Quality rules as a short-circuit cascade.

Every document gets the base figures of one scan (words, symbols, repeated lines, repeated 5-word windows). The other rules
run only on documents that the base rules pass, in an order found on a sample: each rule's time per document and its share
of rejections are measured, and the rules are sorted by rejections per second. A document leaves the cascade at the first
rule that rejects it. The order changes the cost only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name

SYMBOLS = b"#*$%&|<>"  # fixed by the contract
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
SAMPLE_ROWS = 2000  # expected rows of the sample on which the cascade is ordered

OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Doc:
    """What the rules look at: the text and the base figures."""

    text: str
    raw: bytes
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


_ASCII_UPPER, _ASCII_LETTERS, _ASCII = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), bytes(range(128))
_UPPER, _LETTER, _LETTER_WORD = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}"), regex.compile(r"\p{L}[^\x20\x09-\x0D]*+")  # the rest of a word from its first letter: once a word
_BULLETS, _DOTS = ("-", "*", "\u2022"), ("...", "\u2026")


def _count(d: Doc, ascii_: bytes, other) -> int:
    """Characters of an ASCII set and of a category outside ASCII."""
    n = len(d.raw) - len(d.raw.translate(None, ascii_))
    return n if d.raw.isascii() else n + len(other.findall(d.raw.translate(None, _ASCII).decode("utf-8", "surrogatepass")))


def _caps(d: Doc) -> bool:
    return 2 * _count(d, _ASCII_UPPER, _UPPER) > d.word_chars


def _dup_lines(d: Doc) -> bool:
    return 10 * d.n_dup_lines > 3 * (d.raw.count(b"\n") + 1)


def _digits(d: Doc) -> bool:
    return 10 * (len(d.raw) - len(d.raw.translate(None, b"0123456789"))) > 3 * d.word_chars


def _letters(d: Doc) -> bool:
    return 2 * _count(d, _ASCII_LETTERS, _LETTER) < d.word_chars


def _letter_words(d: Doc) -> bool:
    return 2 * len(_LETTER_WORD.findall(d.text)) < d.n_words


def _bullets(d: Doc) -> bool:
    lines = d.text.split("\n")
    return 10 * sum(x.startswith(_BULLETS) for x in lines) > 9 * len(lines)


def _dots(d: Doc) -> bool:
    lines = d.text.split("\n")
    return 10 * sum(x.endswith(_DOTS) for x in lines) > 3 * len(lines)


#: A rule rejects a document; all are independent of each other.
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("mean word length below 2", lambda d: d.word_chars < 2 * d.n_words),
    Rule("mean word length above 15", lambda d: d.word_chars > 15 * d.n_words),
    Rule("repeated lines", _dup_lines),
    Rule("capitals", _caps),
    Rule("digits", _digits),
    Rule("few letters", _letters),
    Rule("few words with a letter", _letter_words),
    Rule("bullets", _bullets),
    Rule("lines that trail off", _dots),
)


def repeat_words(words: list[bytes]) -> int:
    """Words in 5-word windows found twice or more, the first included. Exact: windows are compared by ranks, not hashes."""
    if len(words) <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n = len(ids) - WINDOW + 1
    rank, base = ids[:n].copy(), len(seen)
    for k in range(1, WINDOW):
        nxt = ids[k : k + n]
        if k % 2 == 0 or int(rank.max() + 1) > 2**62 // base:
            rank = np.unique(rank, return_inverse=True)[1]
        rank = rank * base + nxt
    _, inverse, counts = np.unique(rank, return_inverse=True, return_counts=True)
    many = counts[inverse] > 1
    if not many.any():
        return 0
    marks = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]  # bytes.strip() strips U+0009 to U+000D and space
    return len(lines) - len(set(lines))


def base_figures(text: str | None) -> tuple[Doc, int]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at U+0009 to U+000D and space only
    body = b"".join(words)
    chars = len(body) if body.isascii() else len(body) - _continuation(body)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return Doc(text, raw, len(words), chars, symbols, dup_lines(raw)), repeat_words(words)


_CONT = bytes(range(0x80, 0xC0))


def _continuation(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, _CONT))


def order_rules(rules: tuple[Rule, ...], docs: list[Doc], clock=time.perf_counter) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per document, rejected share), by rejections per second; a rule that rejects nothing comes last."""
    found = []
    for i, rule in enumerate(rules):
        began = clock()
        rejected = sum(rule.rejects(d) for d in docs)
        cost = max((clock() - began) / max(1, len(docs)), 1e-9)
        found.append((-rejected / max(1, len(docs)) / cost, i, rule, cost, rejected / max(1, len(docs))))
    return [(rule, cost, share) for _, _, rule, cost, share in sorted(found, key=lambda x: x[:2])]


def sample_order(docs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[int]:
    """Indexes of rules in the order of the cascade, from about `rows` documents (a share of all, by a seeded hash)."""
    total = docs.count()
    share = min(1.0, rows / max(1, total))
    picked = docs.select(F.col(text).alias("text")).sample(share, seed=11)
    schema = "rule int, cost double, share double, n long"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [base_figures(t)[0] for t in pdf["text"]]
            got = order_rules(rules, own)
            yield pd.DataFrame([(rules.index(r), c, s, len(own)) for r, c, s in got], columns=["rule", "cost", "share", "n"])

    mean = picked.mapInPandas(measure, schema).groupBy("rule").agg(F.expr("sum(cost * n) / sum(n)").alias("cost"), F.expr("sum(share * n) / sum(n)").alias("share"))
    by = {r.rule: -r.share / r.cost for r in mean.collect()}
    return sorted(range(len(rules)), key=lambda i: (by.get(i, 0.0), i))


def cascade(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns `keep` (values as they are), the base figures, base_failed and kept; one row per row of docs, nothing is shuffled.

    Null texts have no words and fail the base rules, as do empty ones; a text of any length is judged as a whole. Repeated
    rows are judged alike, and ties of rules in the sample's order go by their place. An empty table gives an empty result.
    Columns beside `text` and `keep` are not read; `keep` may not hold names of the figures.
    """
    figures = [c.split()[0] for c in OUT.split(", ")]
    if clash := [c for c in keep if c.lower() in figures]:
        raise ValueError(f"names of figures can't be kept columns: {clash}")
    order = sample_order(docs, text, rules)
    body = free_name(keep, "__text")
    slim = docs.select(*keep, F.col(text).alias(body))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        for batch in batches:
            rows = []
            for t in batch.column(len(keep)).to_pylist():
                d, n_repeat = base_figures(t)
                failed = d.n_words < LEAST_WORDS or 100 * n_repeat > REPEAT_PERCENT * d.n_words
                kept = not failed and not any(rules[i].rejects(d) for i in order)
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, n_repeat, failed, kept))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, *figures])

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(judge, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), OUT]))
