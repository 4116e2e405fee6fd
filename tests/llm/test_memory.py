"""What passes through the driver, and what a block of postings takes."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parents[2]))
from textloom.llm import common, decontam


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_are_not_broadcast(spark):
    left = spark.range(1000).selectExpr("id % 7 AS k", "id")
    right = spark.range(7).selectExpr("id AS k", "id AS v")
    got = common.spread_join(left, right, "k", None, "id")
    assert got.count() == 1000 and "BroadcastHashJoin" not in plan_of(got)
    hot = common.hot_keys(left.groupBy("k").count().withColumnRenamed("count", "n"), "k")
    dealt = common.spread_join(left, right, "k", hot, "id", "left_anti")
    assert dealt.count() == 0 and "SortMergeJoin" in plan_of(dealt)


def test_postings_are_packed():
    """A block of postings takes a quarter of its positions' 64 bits at most, wherever they stand, and gives the same positions."""
    raw = b" ".join(b"w%d" % (i * i % 7919 % (1 + i % 300)) for i in range(200_000))
    block = decontam._Block(None, 13)
    for i in range(3):
        block.add(i, raw)
    row = block.row(pa.int64()).to_pylist()[0]
    assert len(row["positions"]) * 4 <= 8 * row["ends"][-1] == 8 * 600_000
    words, postings = raw.split(), decontam.Postings(row["terms"], row["ends"], row["positions"])
    for term in (b"w0", b"w7", words[-1]):
        here = np.flatnonzero([w == term for w in words])
        assert np.array_equal(postings.of(term.decode()), np.concatenate([here + s for s in row["starts"]]))
    for places in ([], [0], [5], [3, 2**40, 1, 2**62]):
        assert decontam.unpack(decontam.pack(np.array(places, np.int64)), len(places)).tolist() == places
