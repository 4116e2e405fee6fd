"""Main text of web pages as a maximum-scoring subsequence.

A page is a run of tokens: words and tags. Words score positive and tags negative, by weights per kind of token fitted to
labelled pages; one linear scan finds the contiguous region of the highest sum. Inside the region, what stands in a
boilerplate element (menus, adverts, forms, comments ...) is left out, and the rest is joined block by block. An element is no
boilerplate by its name or class alone: one that holds an article, or most of the page's words outside links, is a wrapper. A
footer or the like beside an article stays boilerplate, however short the article is.

The labelled pages are made by `labelled_pages` from a seed: pages of several layouts whose article tokens are known.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
#: A tag without < inside: tried first, it reads no further than the next <.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")

#: Elements whose content is never text.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title head audio video".split())
#: Elements that are boilerplate wherever they stand.
BOILER = frozenset("nav header footer aside form button menu dialog fieldset label option datalist".split())
#: Words in class, id or role that mark boilerplate.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|foot(?:er)?|header|masthead|comment\w*|disqus\w*|respond|reply|replies|"
    r"cookie\w*|consent|notice\w*|alert\w*|popup|modal|newsletter|subscri\w*|share|sharing|social\w*|related|recommend\w*|widget\w*|pag(?:er|ination)|search\w*|login|skip\w*|toolbar|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I
)
#: Of these, the ones that readers write: they may be longer than the article, and hold articles of their own.
READERS = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus\w*|respond|reply|replies)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: End tags that HTML lets a page leave out: a start tag of the key closes an open one of the values.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

KINDS = ("word", "link word", "boiler word", "inline tag", "block tag", "paragraph tag", "list tag", "boiler tag", "main tag")
WORD, LINKED, BOILED, INLINE_TAG, BLOCK, PARAGRAPH, LIST, BOILER_TAG, MAIN = range(len(KINDS))


def _marked(attrs: str) -> bool:
    return any(MARKS.search(m.strip("\"'")) for m in _ATTR.findall(attrs)) or bool(_HIDDEN.search(attrs))


class Finder:
    """str.find from growing places of one text; that something doesn't occur any more is found out once."""

    def __init__(self, raw: str):
        self.raw, self.next, self.ends = raw, {}, {}

    def find(self, what: str, at: int) -> int:
        """First place of `what` from `at` on, or -1."""
        known = self.next.get(what)
        if known is None or 0 <= known < at:
            known = self.next[what] = self.raw.find(what, at)
        return known

    def tag_end(self, at: int) -> int:
        """Place behind the > that ends a tag, signs in quotes left out; -1 if there is none. The walk from a sign to the end is remembered for all signs it passes."""
        passed, end = [], None
        first = [p for p in (self.find(c, at) for c in ">\"'") if p >= 0]
        sign = min(first) if first else -1
        while end is None:
            if sign < 0 or sign in self.ends:
                end = self.ends.get(sign, -1)
                break
            passed.append(sign)
            if self.raw[sign] == ">":
                end = sign + 1
            else:
                close = self.raw.find(self.raw[sign], sign + 1)
                m = _SPECIAL.search(self.raw, close + 1) if close >= 0 else None
                sign = m.start() if m else -1
        self.ends.update(dict.fromkeys(passed, end))
        return end


def tokens(raw: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of tags, with an empty name for comments and declarations; time in proportion to the page.

    The caller may move on: tokens that start before the place sent back are left out.
    """
    finder, at, skip = Finder(raw), 0, 0
    while (at := raw.find("<", max(at, skip))) >= 0:
        if m := _PLAIN.match(raw, at):
            found = (at, m.end(), m[2].lower(), bool(m[1]), m[3])
        elif raw.startswith("<!--", at) or raw.startswith("<![CDATA[", at):
            close = "-->" if raw.startswith("<!--", at) else "]]>"
            end = finder.find(close, at)
            end = len(raw) if end < 0 else end + len(close)
            found = (at, end, "", False, "")
        elif raw.startswith(("<!", "<?"), at):
            end = finder.find(">", at) + 1
            found = (at, end, "", False, "") if end else None
        else:
            m = _NAME.match(raw, at)
            end = finder.tag_end(m.end()) if m else -1
            found = (at, end, m[2].lower(), bool(m[1]), raw[m.end() : end - 1]) if end > 0 else None
        if found is None:
            at += 1  # a sign of its own
        else:
            skip = (yield found) or 0
            at = found[1]


class Page:
    """Tokens of a page: kind of each token, and of text tokens the raw text, the block and whether it is boilerplate."""

    def __init__(self, raw: str):
        self.kinds: list[int] = []
        self.counts: list[int] = []  # words of a text token, 1 for a tag
        self.pieces: dict[int, tuple[str, int]] = {}
        self.block = 0
        self.bad: list[list] = []  # boilerplate elements: first and last token, readers' words or not, kind of the tag otherwise, boilerplate by the element's name or not
        self.heads: list[int] = []  # tokens that open an article
        self.articles: list[list[int]] = []  # first and last token of the articles outside boilerplate
        self.titles: list[int] = []  # tokens that open a page's title
        stack: list[tuple[str, int, int]] = []  # name, numbers of the boilerplate element and of the article, or -1
        inside = 0  # open boilerplate elements
        open_: Counter = Counter()
        links = at = 0
        end = len(raw)
        marked: dict[str, bool] = {}
        low = Finder(raw.lower()) if len(raw.lower()) == end else Finder(raw)
        found = tokens(raw)

        def close(n: int) -> None:
            nonlocal links, inside
            for name, bad, article in stack[n:]:
                if bad >= 0:
                    self.bad[bad][1] = len(self.kinds)
                    inside -= 1
                if article >= 0:
                    self.articles[article][1] = len(self.kinds)
                links -= name == "a"
                open_[name] -= 1
            del stack[n:]

        token = next(found, None)
        while token is not None:
            start, stop, name, closing, attrs = token
            if start > at:
                self._text(raw[at:start], links)
            at = stop
            if name and name in RAW and not closing:
                if not attrs.rstrip().endswith("/"):
                    at = self._behind(raw, low, name, at, end)
                self._tag(BOILER_TAG)
                self.block += name not in ("svg", "math")
            elif name:
                if name not in INLINE:
                    self.block += 1
                if closing:
                    bad = False
                    if open_[name] > 0:
                        depth = len(stack) - 1
                        while stack[depth][0] != name:
                            depth -= 1
                        bad = stack[depth][1] >= 0
                        close(depth)
                else:
                    if name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
                        close(len(stack) - 1)
                    bad = marked.get(name + attrs)
                    if bad is None:
                        bad = marked[name + attrs] = name in BOILER or (name not in ("html", "body", "article", "main") and bool(attrs) and _marked(attrs))
                    if name in ("article", "main"):
                        self.heads.append(len(self.kinds))
                    elif name == "h1":
                        self.titles.append(len(self.kinds))
                    if name not in VOID and not attrs.endswith("/"):
                        article = name in ("article", "main") and not inside
                        stack.append((name, len(self.bad) if bad else -1, len(self.articles) if article else -1))
                        open_[name] += 1
                        links += name == "a"
                        if bad:
                            self.bad.append([len(self.kinds), 0, bool(READERS.search(" ".join(m.strip("\"'") for m in _ATTR.findall(attrs)))), self._kind(name), name in BOILER])
                            inside += 1
                        if article:
                            self.articles.append([len(self.kinds), 0])
                self._tag(BOILER_TAG if bad else self._kind(name))
            try:
                token = found.send(at)
            except StopIteration:
                token = None
        if at < end:
            self._text(raw[at:], links)
        close(0)
        self._wrappers()

    @staticmethod
    def _behind(raw: str, low: Finder, name: str, at: int, end: int) -> int:
        """Place behind the end tag of an element without text; one that is never closed takes the rest of the page, or nothing if pages often leave it open."""
        close = low.find(f"</{name}", at)
        while close >= 0:
            stop = close + 2 + len(name)
            rest = raw[stop : stop + 1]
            if rest == ">" or rest.isspace():
                return low.find(">", stop) + 1 or end
            close = low.find(f"</{name}", stop)
        return at if name in ("head", "title", "object", "audio", "video", "canvas") else end

    @staticmethod
    def _kind(name: str) -> int:
        return MAIN if name in ("article", "main") else INLINE_TAG if name in INLINE else PARAGRAPH if name in ("p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") else LIST if name in ("ul", "ol", "li", "dl", "dd", "dt") else BLOCK

    def _wrappers(self) -> None:
        """Words inside boilerplate are told by the elements that stay boilerplate: none that holds an article, or over half of the page's words outside links, unless it is a footer or the like (by the element's name) beside an article with words; what readers wrote stays unless it holds the page's title too."""
        kinds, n = np.array(self.kinds, np.int64), len(self.kinds)
        plain = np.concatenate([[0], np.cumsum(np.where(kinds == WORD, self.counts, 0))])
        heads, titles = np.array(self.heads, np.int64), np.array(self.titles, np.int64)
        depth = np.zeros(n + 1, np.int64)
        has = lambda places, a, b: bool(np.searchsorted(places, b) > np.searchsorted(places, a))
        said = [(a, b) for a, b in self.articles if plain[b] > plain[a]]
        first_end, last_start = min((b for _, b in said), default=n + 1), max((a for a, _ in said), default=-1)
        for a, b, readers, kind, named in self.bad:
            beside = named and (first_end <= a or last_start >= b)
            wraps = has(heads, a, b) or not beside and 2 * (plain[b] - plain[a]) > plain[n]
            if wraps and (not readers or has(titles, a, b)):
                self.kinds[a] = kind
            else:
                depth[a] += 1
                depth[b] -= 1
        for i in np.flatnonzero(np.cumsum(depth)[:n] > 0).tolist():
            if self.kinds[i] in (WORD, LINKED):
                self.kinds[i] = BOILED

    def _tag(self, kind: int) -> None:
        self.kinds.append(kind)
        self.counts.append(1)

    def _text(self, text: str, links: int) -> None:
        n = len(text.split())
        self.pieces[len(self.kinds)] = (text, self.block)
        self.kinds.append(LINKED if links else WORD)
        self.counts.append(n)


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """Bounds [a, b) of the contiguous run of the highest sum, the first and shortest of equals; (0, 0) if no sum is above 0."""
    if not len(scores):
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(total)
    gain = total - low
    b = int(gain.argmax())
    if gain[b] <= 0:
        return 0, 0
    a = int(np.flatnonzero(total[: b + 1] == low[b])[-1])
    return a, b


def extract(raw: str | None, weights: np.ndarray) -> str:
    """Text of the best region: blocks in page order joined by newlines, white space inside a block turned into one space."""
    page = Page(raw or "")
    kinds = np.array(page.kinds, np.int64)
    a, b = best_region(weights[kinds] * np.array(page.counts, np.float64)) if len(kinds) else (0, 0)
    blocks: dict[int, list[str]] = {}
    for i in range(a, b):
        if kinds[i] in (WORD, LINKED) and i in page.pieces:
            text, block = page.pieces[i]
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


# -- weights -----------------------------------------------------------------------------------------------------------
def labelled_pages(seed: int = 3, n: int = 160) -> list[tuple[str, set[str]]]:
    """Pages of several layouts with the words of their article; article words start with m, all others with x."""
    rng, out = random.Random(seed), []
    for p in range(n):
        count = [0]

        def words(lo: int, hi: int, kind: str) -> str:
            k = rng.randint(lo, hi)
            count[0] += k
            return " ".join(f"{kind}{p}w{count[0] - j}" for j in range(k))

        link = lambda lo=1, hi=3, kind="x": f'<a href="/{rng.randint(1, 99)}">{words(lo, hi, kind)}</a>'
        menu = lambda tag, attrs="": f"<{tag}{attrs}><ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(3, 12)))}</ul></{tag}>"
        body = []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            text = words(3, 90, "m")
            if kind < 0.6:
                body.append(f"<p>{text} {link(1, 2, 'm') if rng.random() < 0.3 else ''} <b>{words(1, 3, 'm')}</b></p>")
            elif kind < 0.7:
                body.append(f"<h2>{words(1, 8, 'm')}</h2>")
            elif kind < 0.8:
                body.append("<ul>" + "".join(f"<li>{words(2, 12, 'm')}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{text}</blockquote><div class='ad'>{words(2, 12, 'x')}</div>")
            else:
                body.append(f"<p><b>{words(1, 9, 'm')}<br><p>{words(2, 30, 'm')}")
            if rng.random() < 0.3:  # what pages put between the paragraphs
                body.append(rng.choice(["<div class='ad'>{}</div>", "<form><label>{}</label><input><button>ok</button></form>", "<aside><p>{}</p></aside>", "<div class='newsletter'><p>{}</p><form><input></form></div>"]).format(words(2, 15, "x")))
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='content'><div>{}</div></div>", "<td>{}</td>"])
        main = wrap.format(f"<h1>{words(1, 9, 'm')}</h1>" + "".join(body))
        before = rng.choice([menu("nav"), menu("div"), menu("header"), menu("div", " class='menu'")]) + rng.choice(["", f"<div class='ad'>{words(3, 20, 'x')}</div>", f"<div>{link()} | {link()}</div>"])
        after = rng.choice(["", menu("aside"), menu("div"), f"<div class='comments'><p>{words(5, 40, 'x')}</p></div>"]) + rng.choice([f"<footer>{words(2, 14, 'x')}</footer>", f"<div class='footer'>{link()} {words(1, 6, 'x')}</div>"])
        out.append((f"<html><head><title>{words(2, 8, 'x')}</title></head><body>{before}{main}{after}</body></html>", {f"m{p}"}))
    return out


@lru_cache(maxsize=1)
def fitted_weights(seed: int = 3, rounds: int = 4) -> tuple[float, ...]:
    """Weights by coordinate search: the F1 of the words in the region against the labelled pages' article words, and the share of pages that are exactly right."""
    pages = [(Page(raw), raw) for raw, _ in labelled_pages(seed)]
    parsed = []
    for page, _ in pages:
        good = np.array([sum(w.startswith("m") for w in page.pieces[i][0].split()) if i in page.pieces else 0 for i in range(len(page.kinds))])
        parsed.append((np.array(page.kinds), np.array(page.counts, float), good))

    def quality(w: np.ndarray) -> float:
        total = 0.0
        for kinds, counts, good in parsed:
            a, b = best_region(w[kinds] * counts)
            shown = np.isin(kinds[a:b], (WORD, LINKED))
            right, got, want = good[a:b][shown].sum(), counts[a:b][shown].sum(), good.sum()
            total += 2 * right / max(1, got + want) + (right == got == want)
        return total / len(parsed)

    w = np.array([1.0, 0.2, 0.0, -0.3, -2.0, -0.5, -1.0, -1.0, -1.0])
    best = quality(w)
    for _ in range(rounds):
        for k in range(1, len(w)):  # the weight of a word fixes the scale
            for step in (0.5, 0.8, 1.25, 2.0, -1.0):
                new = w.copy()
                new[k] = w[k] * step
                if k >= INLINE_TAG and new[k] > 0:
                    continue
                got = quality(new)
                if got > best + 1e-6:
                    best, w = got, new
    return tuple(np.round(w, 4).tolist())


def main_text(pages: DataFrame, *, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` and text, the main text of every page, empty if there is none; one row per row of pages, nothing is shuffled.

    A null page is an empty one. Broken markup is read as far as it goes, in time in proportion to the page: an unclosed element
    ends with the page, a tag without its > is text. A br ends a block, as it starts a new line on the page. Of regions with
    equal sums the first and shortest is taken. Repeated rows give equal texts; an empty table gives an empty result; other
    columns are not read, and `keep` may not hold the name of the result.
    """
    if "text" in [c.lower() for c in keep]:
        raise ValueError("the name of the result can't be a kept column: text")
    weights = fitted_weights()
    slim = pages.select(*keep, F.col(page).alias(free_name(keep, "__html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in batches:
            text = pa.array([extract(x, w) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], text], names=[*keep, "text"])

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))
