"""Results that a cut in an operator would shorten."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
from textloom.llm import suffix_dedup


def test_many_occurrences_against_one(spark):
    """A passage 100 times in one text and once in another is found at every place; pairs among many texts of one seed are found too."""
    r = random.Random(3)
    w = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, a, want = w(60), [], set()
    for _ in range(100):
        a += w(r.randrange(20, 40))
        want.add((1, len(a), len(a) + 60))
        a += passage
    docs = [(1, " ".join(a + w(30))), (2, " ".join(w(25) + passage + w(25)))]
    want.add((2, 25, 85))
    core = w(40)
    for i in range(40):  # pairs of texts: 40 words that all share, and 12 of their own before or after
        left, right = w(12), w(12)
        for k in range(2):
            head = w(20 + i % 7)
            docs.append((100 + 2 * i + k, " ".join(head + left + core + w(30) if i % 2 else head + core + right + w(30))))
            want.add((100 + 2 * i + k, len(head), len(head) + 52))
    got = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.start, x.end) for x in got} == want and len(got) == len(want)
