"""SimHash near duplicates: fingerprints met in a grid of their segments' bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits; their bit counts (0, 1 or 2) are a vector. The Manhattan distance of
two such vectors is never above the number of differing bits, so it is a lower bound. Fingerprints that differ in at most four
bits are within two of each other in the first half of the vector or within one in the second, and each half is a grid of its own:

- first half: a vector is put into its own cell and those next to it (one count changed by one); vectors at a distance of two share
  the cell between them;
- second half: vectors of an even sum are put into their own cell, odd ones into those next to it too; vectors at a distance of one
  have different parities.

Whatever meets in a cell is verified on the whole fingerprints. Equal fingerprints enter once. Each one is compared with the hub of
its cell first (a star); pairs of a cell are looked at only where they still belong to different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, hot_keys, materialise, release, sorted_join, spread_join
from textloom.llm.ngram_join import components

N, DISTANCE, SEED = 4, 4, 42
CELL_SHARE = 256  # the pairs of a cell that holds over 1/256 of all places are dealt over tasks
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LANES = np.uint64(0x0101010101010101)
_BLOCK = 255  # rows that a byte's lane can count


def shingle_hashes(raw: bytes, n: int = N) -> np.ndarray:
    """XXH64 of the n-word shingles, repeats included; of fewer words, one of the whole; of none, none."""
    words = raw.translate(_LOWER).split()  # bytes.split() splits at U+0009 to U+000D and space only
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, k = np.concatenate([[0], ends[:-1] + 1]), min(n, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    count = len(words) - k + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, count)


def fingerprints_of(sets: list[np.ndarray]) -> np.ndarray:
    """One fingerprint a list of hashes: a bit is set if it is in over half of them; of no hashes, zero."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    hashes, sizes = np.concatenate([sets[i] for i in full]), sizes[full]
    # blocks of up to 255 hashes of one text: eight bits are counted at once in the eight bytes of a number
    blocks = -(-sizes // _BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + within * _BLOCK
    got = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        for byte in range(8):
            got |= (2 * ones[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + j)
    out[full] = got
    return out


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = N) -> DataFrame:
    """(doc_id, fp) of every row, from its whole text; fp is signed. Null texts and texts without words have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x.as_buffer().to_pybytes(), n) if x.is_valid else np.zeros(0, np.uint64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(sets).view(np.int64))], names=["doc_id", "fp"])
        release()

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, fp long")


def cells(nodes: DataFrame) -> DataFrame:
    """The columns of nodes (fp, ...) and cell: the grid cells of distinct fingerprints. A cell's number writes the 16 counts to base 3."""
    # a row becomes up to 66: dealt out anew, as a few small files hold many rows
    dealt = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    counts = lambda half: f"transform(sequence(0, 15), i -> bit_count(shiftright(fp, 2 * i + {32 * half}) & 3L))"
    at = dealt.select("*", F.expr(counts(0)).alias("v0"), F.expr(counts(1)).alias("v1"))
    code = lambda v: F.expr(f"aggregate({v}, 0L, (a, x) -> 3 * a + x)")
    at = at.withColumn("c0", code("v0")).withColumn("c1", code("v1") + 3**16)
    odd = F.expr("aggregate(v1, 0, (a, x) -> a + x) % 2 = 1")
    step = "cast(pow(3, 15 - i) as bigint)"
    near = lambda v, c: F.expr(f"concat(transform({v}, (x, i) -> if(x < 2, {c} + {step}, NULL)), transform({v}, (x, i) -> if(x > 0, {c} - {step}, NULL)))")
    own = F.array("c0", "c1")
    all_cells = F.concat(own, near("v0", "c0"), F.when(odd, near("v1", "c1")).otherwise(F.array().cast("array<bigint>")))
    return at.select(*nodes.columns, F.explode(F.filter(all_cells, lambda c: c.isNotNull())).alias("cell"))


def link_components(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, root) of the fingerprints (a written table: fp, copies) that are connected with a smaller one: root is the smallest of them."""
    grid = cells(nodes)
    star = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max_by("fp", F.struct("copies", "fp")).alias("hub")).filter("n > 1")
    star = materialise(star, "star")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    met = spread_join(grid.select("cell", "fp"), star.select("cell", "hub"), "cell", hot_keys(star, "cell", CELL_SHARE), "fp", where=(F.col("fp") != F.col("hub")) & close("fp", "hub"))
    first = materialise(met.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct(), "spokes")
    comp = materialise(components(first), "components")
    # a cell all of whose fingerprints belong to one component by now is settled; pairs of the others are compared where the components differ
    rooted = materialise(nodes.join(sorted_join(comp), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("comp")), "rooted")
    grid = cells(rooted)
    state = grid.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    state = materialise(state.select("cell", "n", (F.col("lo") == F.col("hi")).alias("settled")), "state")
    open_ = hot_keys(state.filter("NOT settled").select("cell", "n"), "cell", CELL_SHARE)
    at = materialise(spread_join(grid, state.filter("settled").select("cell"), "cell", hot_keys(state.select("cell", "n"), "cell", CELL_SHARE), "fp", "left_anti"), "at")
    x, y = (at.select("cell", *(F.col(c).alias(c + s) for c in ("fp", "comp"))) for s in "xy")
    apart = (F.col("fpx") < F.col("fpy")) & (F.col("compx") != F.col("compy")) & close("fpx", "fpy")
    rest = materialise(spread_join(x, y, "cell", open_, "fpx", where=apart).select(F.col("fpx").alias("u"), F.col("fpy").alias("v")).distinct(), "rest")
    found = materialise(components(first.unionByName(rest)), "components")
    discard(star, first, comp, rooted, state, at, rest)
    return found


def near_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = N, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (signed), component_id: the smallest doc_id reachable by links of at most `distance` (up to 4) differing bits, itself included.

    Each row is a document of its own; repeated rows are linked with each other. doc_id may have any type that has an order; a
    null one takes part in links and gives no component_id. Null and empty texts have the fingerprint zero and are linked like any
    other. Texts of any length are read as a whole. An empty table gives an empty result; other columns are not read, whatever
    their names.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the grid's halves find up to {DISTANCE} differing bits")
    rows = materialise(fingerprints(docs, text=text, doc_id=doc_id, n=n), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")), "nodes")
    comp = link_components(nodes.select("fp", "copies"), distance)
    rooted = materialise(nodes.join(sorted_join(comp), F.col("fp") == F.col("node"), "left").select("fp", "copies", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    top = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = spread_join(rooted.select("fp", "root"), top.drop("n"), "root", hot_keys(top.select("root", "n"), "root"), "fp").select("fp", "component_id")
    return spread_join(rows, named, "fp", hot_keys(nodes.select("fp", F.col("copies").alias("n")), "fp"), "doc_id").select("doc_id", "fp", "component_id")
