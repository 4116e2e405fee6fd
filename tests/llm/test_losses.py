"""Cases that were once lost: passages of periodic text, pages inside wrappers, texts of very many candidates."""

import itertools
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parents[2])]
from textloom.llm import html_extract, suffix_dedup


def common_spans(a, b):
    """Words of a that passages of 50 words shared with b cover, as spans."""
    there = {tuple(b[i : i + 50]) for i in range(len(b) - 49)}
    hit = {k for i in range(len(a) - 49) if tuple(a[i : i + 50]) in there for k in range(i, i + 50)}
    out = []
    for _, run in itertools.groupby(enumerate(sorted(hit)), lambda x: x[1] - x[0]):
        run = [x for _, x in run]
        out.append((run[0], run[-1] + 1))
    return out


def test_periodic_passages(spark):
    rng, rows, want = random.Random(4), [], []
    for n in range(300):
        own = lambda k, n=n: [f"{n}o{rng.random()}" for _ in range(k)]
        size = rng.choice([1, 2, 3, 7, 10, 10, 20, 34, 40])
        period, tail = [f"{n}p{i}" for i in range(size)], [f"{n}t{i}" for i in range(rng.choice([0, 5, 20, 60]))]
        times = lambda: rng.randint(1, max(2, 90 // size))  # noqa: E731, B023
        pair = [own(rng.randrange(50)) + period * times() + tail + own(rng.randrange(50)) + (period * times() if rng.random() < 0.3 else []) for _ in range(2)]
        for i, (a, b) in enumerate((pair, pair[::-1])):
            rows.append((2 * n + i, " ".join(a)))
            want += [(2 * n + i, s, e) for s, e in (common_spans(a, b) if a != b else [(0, len(a))] * (len(a) >= 50))]
    period = [f"q{i}" for i in range(10)]
    a, b = [f"a{i}" for i in range(40)] + period * 4 + [f"t{i}" for i in range(20)] + [f"b{i}" for i in range(40)], [f"c{i}" for i in range(40)] + period * 3 + [f"t{i}" for i in range(20)] + [f"d{i}" for i in range(40)]
    rows += [(1000, " ".join(a)), (1001, " ".join(b)), (1002, "w " * 100_000), (1003, "w " * 60 + "end")]
    want += [(1000, s, e) for s, e in common_spans(a, b)] + [(1001, s, e) for s, e in common_spans(b, a)] + [(1002, 0, 100_000), (1003, 0, 60)]
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == sorted(want)


ARTICLE = "<h1>A title</h1>" + "".join(f"<p>Sentence number {i} of the article, which goes on for some more words.</p>" for i in range(25))
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8)) + "</ul>"
COMMENTS = "".join(f"<article class='comment'><p>Comment {i} says a lot and much too long for anybody.</p></article>" for i in range(90))


@pytest.mark.parametrize(
    "page",
    [
        f"<form id='aspnetForm'><nav>{MENU}</nav><div>{ARTICLE}</div></form>", f"<nav>{MENU}</nav><div class='content has-sidebar'>{ARTICLE}</div>", f"<div id='page' class='no-sidebar'><nav>{MENU}</nav>{ARTICLE}</div>", f"<div class='with-header'><article>{ARTICLE}</article></div>",
        f"<nav>{MENU}</nav><div class='social-post'>{ARTICLE}</div>", f"<nav>{MENU}<article>{ARTICLE}</article>", f"<nav>{MENU}</nav><article>{ARTICLE}</article><div id='comments'>{COMMENTS}</div>", f"<div>{ARTICLE}<form><label>Name</label><input></form></div><aside><p>See also</p></aside><div class='comments'>{COMMENTS}</div>",
    ],
)
def test_wrapped_pages(page):
    weights = np.array(html_extract.fitted_weights())
    got = html_extract.extract(f"<html><body>{page}<footer>Imprint</footer></body></html>", weights)
    assert got == "A title\n" + "\n".join(f"Sentence number {i} of the article, which goes on for some more words." for i in range(25))


def test_line_index_reopens(spark, tmp_path, monkeypatch):
    from textloom.llm import line_dedup

    at, rng = f"file://{tmp_path}/index", random.Random(9)
    rows = [(i, "\n".join(f"line number {rng.randrange(12)} of all the texts" for _ in range(5))) for i in range(40)]
    docs = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    kept = lambda r: {x.doc_id: x.kept for x in r.collect()}
    want = lambda live: kept(line_dedup.dedup_lines(docs(live)))
    line_dedup.LineIndex(spark, at, shards=3).insert(docs(rows[:30]))
    again = line_dedup.LineIndex(spark, at)
    assert again.version == 1 and again.shards == 3
    again.insert(docs(rows[30:]))
    again.delete(docs(rows[:10]))
    third = line_dedup.LineIndex(spark, at)
    assert kept(third.apply(docs(rows[10:]))) == want(rows[10:])
    for gone in (rows[:1], [(99, rows[20][1])]):
        with pytest.raises(ValueError, match="not inserted"):
            third.delete(docs(gone))
    third.insert(docs([(99, rows[20][1])]))
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 1)  # twelve keys need more than three shards now
    third.insert(docs([(100, "a line of its own, which is long enough")]))
    last = line_dedup.LineIndex(spark, at)
    live = [*rows[10:], (99, rows[20][1]), (100, "a line of its own, which is long enough")]
    assert last.shards > 3 and kept(last.apply(docs(live))) == want(live)


def test_many_candidates_in_a_text(spark):
    """Time in proportion to the candidates of a text: 100,000 numbers, near numbers that overlap, none."""
    import time

    from textloom.llm import pii

    numbers = " or ".join(f"call 0{i % 9 + 1}{i:05d} {i % 97:02d} {i % 89:02d}" for i in range(25_000))
    took = []
    for text in (numbers[: len(numbers) // 4], numbers):
        began = time.perf_counter()
        got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("phone_added").first()
        took.append(time.perf_counter() - began)
        places = [(x.s, x.e) for x in got.phone_added]
        assert places == sorted(places) and all(a[1] <= b[0] for a, b in itertools.pairwise(places))
    assert took[1] < 8 * took[0] + 20
