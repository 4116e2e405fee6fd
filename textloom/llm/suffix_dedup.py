"""Passages repeated across documents, by a sparse suffix array.

Of all word suffixes only those are retained that start at content-selected minimiser positions: the smallest hash among WINDOW
successive SEED-word runs. Any passage of WINDOW + SEED - 1 = 50 words holds a retained position, the same one in each copy.
Suffixes that start with a seed found in different documents are sorted by what follows the seed; each is compared with its
neighbours, and the match is extended right and left, word by word. That meets all pairs of a seed with NEIGHBOURS + 1 contexts at
most; of a seed with more, the 50-word windows that hold it are grouped by their hashes, and a window of two classes is a match,
so no match is lost at any number of contexts.

A match may reach REACH words beyond its seed on either side; matches of successive positions overlap, so their union covers
passages of any length. Texts with equal words are one class and enter once; equal contexts are one row, so neither large
groups of copies nor a passage in very many documents makes a large group. Rows of a hot seed or class are dealt over many tasks.

A class is known by two 64-bit hashes of all its words (node, check). That a seed or window occurs in two classes is read
from node alone: a pair of classes of equal node would hide what only these two share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, hot_keys, materialise, release, spread_join

LEAST, SEED = 50, 16
WINDOW = LEAST - SEED + 1
REACH = LEAST - SEED
NEIGHBOURS = 4
BROADCAST_ROWS = 1 << 21
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 9)
        return got


def word_hashes(raw: bytes, memo: Words) -> np.ndarray:
    words = raw.translate(_LOWER).split()  # bytes.split() splits at U+0009 to U+000D and space only
    return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int = SEED) -> np.ndarray:
    """A hash of each run of k words, from prefix sums modulo 2^64."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    down = np.cumprod(np.full(len(h), _INVERSE, np.uint64))
    up = np.cumprod(np.full(len(h), _BASE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down)])
    return _mix((total[k:] - total[:-k]) * up[: len(h) - k + 1])


def minimisers(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the leftmost smallest value of each window, every one of them: what is retained of a passage depends on its own words alone."""
    if len(x) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(x, window)
    return np.unique(view.argmin(1) + np.arange(len(view)))


def sign_of(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of all words."""
    got = xxhash.xxh3_128_intdigest(h.tobytes())
    high, low = got >> 64, got & (1 << 64) - 1
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(name)]


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def suffixes(slim: DataFrame) -> DataFrame:
    """(rid, doc_id, n, node, check, at, seeds) of every row: node and check are hashes of all its words; at and seeds are the retained positions and their seeds' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            n, nodes, checks, at, seeds = [], [], [], [], []
            for t in _texts(batch, "text"):
                h = word_hashes(t, memo)
                x = run_hashes(h)
                m = minimisers(x)
                node, check = sign_of(h)
                n.append(len(h))
                nodes.append(node)
                checks.append(check)
                at.append(m.astype(np.int32))
                seeds.append(x[m].view(np.int64))
            cols = [batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), _lists(at, pa.int32()), _lists(seeds, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "n", "node", "check", "at", "seeds"])
        del memo
        release()

    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"rid long, doc_id {kind}, n long, node long, check long, at array<int>, seeds array<long>")


def contexts(rows: DataFrame) -> DataFrame:
    """(node, check, pos, last, seed, before, after) of rows (node, check, text, at): up to REACH words on either side of a seed, 4 bytes a word, `before` read backwards.

    Places of a text with equal contexts, each less than LEAST words behind the one before (periodic text), are one row, from pos to last: what matches there has LEAST words
    at least, so the matches of these places make one span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            nodes, checks, places, lasts, seeds, before, after = [], [], [], [], [], [], []
            for t, node, check, at in zip(_texts(batch, "text"), *(batch.column(c).to_pylist() for c in ("node", "check", "at")), strict=True):
                h = word_hashes(t, memo)
                if sign_of(h) != (node, check):
                    continue  # another text of the same row id
                x, low = run_hashes(h), (h >> np.uint64(32)).astype(np.uint32)
                row: dict[tuple[int, bytes, bytes], int] = {}  # where a context's newest row is
                for p, seed in zip(at, x[at].view(np.int64).tolist(), strict=True):
                    key = seed, low[max(0, p - REACH) : p][::-1].tobytes(), low[p + SEED : p + SEED + REACH].tobytes()
                    i = row.get(key)
                    if i is not None and p - lasts[i] < LEAST:
                        lasts[i] = p
                        continue
                    row[key] = len(places)
                    places.append(p)
                    lasts.append(p)
                    seeds.append(seed)
                    before.append(key[1])
                    after.append(key[2])
                nodes += [node] * (len(places) - len(nodes))
                checks += [check] * (len(places) - len(checks))
            cols = [pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(places, pa.int32()), pa.array(lasts, pa.int32()), pa.array(seeds, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "check", "pos", "last", "seed", "before", "after"])
        del memo
        release()

    return rows.select("node", "check", "text", "at").mapInArrow(run, "node long, check long, pos int, last int, seed long, before binary, after binary")


def _grid(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of contexts as rows of one width, and their numbers."""
    size = np.array([len(v) // 4 for v in values], np.int64)
    flat = np.frombuffer(b"".join(v.ljust(4 * REACH, b"\0") for v in values), np.uint32).reshape(len(values), REACH)
    return flat, size


def _common(grid: np.ndarray, size: np.ndarray, d: int) -> np.ndarray:
    """Leading words that row i and row i + d share."""
    same = np.cumprod(grid[d:] == grid[:-d], axis=1).sum(1)
    return np.minimum(same, np.minimum(size[d:], size[:-d]))


def compare(ctx: np.ndarray, seed: np.ndarray, before: list[bytes], after: list[bytes], lo: np.ndarray, hi: np.ndarray, new_from: int = 0) -> list[tuple[int, int, int]]:
    """(ctx, left, right) of neighbours, up to NEIGHBOURS apart, whose match has LEAST words and lies in different classes. Pairs before new_from are known."""
    found = []
    if len(ctx) < 2:
        return found
    (b, nb), (a, na) = _grid(before), _grid(after)
    for d in range(1, min(NEIGHBOURS, len(ctx) - 1) + 1):
        i = np.flatnonzero((seed[d:] == seed[:-d]) & (np.arange(d, len(ctx)) >= new_from) & ~((lo[d:] == hi[d:]) & (lo[:-d] == hi[:-d]) & (lo[d:] == lo[:-d])))
        if len(i):
            left, right = _common(b, nb, d)[i], _common(a, na, d)[i]
            good = left + SEED + right >= LEAST
            for k, x, y in zip(i[good], left[good], right[good], strict=True):
                found += [(int(ctx[k]), int(x), int(y)), (int(ctx[k + d]), int(x), int(y))]
    return found


def windows(table: DataFrame) -> DataFrame:
    """(ctx, lo, hi, k, w): the windows of LEAST words around the seeds of contexts; w is the hash of one that starts k words before its seed."""
    left, right = (F.length("before") / 4).cast("int"), (F.length("after") / 4).cast("int")
    k = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(REACH) - right), F.least(F.lit(REACH), left)))
    rows = table.filter(left + right >= REACH).select("ctx", "lo", "hi", "seed", "before", "after", k.alias("k"))
    w = F.xxhash64("seed", "k", F.substring("before", F.lit(1), F.col("k") * 4), F.substring("after", F.lit(1), (F.lit(REACH) - F.col("k")) * 4))
    return rows.select("ctx", "lo", "hi", "k", w.alias("w"))


def grouped(table: DataFrame) -> DataFrame:
    """(ctx, left, right) of contexts with a window in another class. Matches hold the seed, so the outermost windows give their union."""
    rows = windows(table)
    met = materialise(rows.groupBy("w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("w"), "windows")
    met = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met
    return rows.join(met, "w", "left_semi").groupBy("ctx").agg(F.max("k").alias("left"), (F.lit(REACH) - F.min("k")).alias("right"))


def neighbours(table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(ctx, left, right) from one sorted order of contexts. Sorted ranges are read as streams; rows at the ends of ranges, NEIGHBOURS each, meet on the driver."""
    names = ["ctx", "seed", "before", "after", "lo", "hi"]
    schema = "ctx long, left int, right int, edge boolean, seed long, before binary, after binary, lo long, hi long"
    spark = table.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            known = 0 if held is None else held.num_rows
            col = {n: whole.column(n).to_pylist() for n in ("before", "after")}
            num = {n: whole.column(n).to_numpy() for n in ("ctx", "seed", "lo", "hi")}
            found = compare(num["ctx"], num["seed"], col["before"], col["after"], num["lo"], num["hi"], known)
            if found:
                x = np.array(found, np.int64)
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1], pa.int32()), pa.array(x[:, 2], pa.int32()), pa.array([False] * n), *(pa.nulls(n, k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=_EDGE)
            if first:
                yield _edge(whole.slice(0, NEIGHBOURS))
                first = False
            held = whole.slice(max(0, whole.num_rows - NEIGHBOURS))
        if held is not None:
            yield _edge(held)

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = materialise(table.select(*names).repartitionByRange(ranges, *by).sortWithinPartitions(*by).mapInArrow(run, schema), "neighbours")
    rows = done.filter("edge").select(*names).distinct().collect()
    at = [names.index(c) for c in by]
    rows.sort(key=lambda r: tuple(bytes(r[i]) if isinstance(r[i], (bytes, bytearray)) else r[i] for i in at))
    met = []
    if rows:
        num = {n: np.array([r[n] for r in rows], np.int64) for n in ("ctx", "seed", "lo", "hi")}
        met = compare(num["ctx"], num["seed"], [bytes(r.before) for r in rows], [bytes(r.after) for r in rows], num["lo"], num["hi"])
    out = done.filter("NOT edge").select("ctx", "left", "right")
    return out.unionByName(spark.createDataFrame(met, "ctx long, left int, right int")) if met else out


_EDGE = ["ctx", "left", "right", "edge", "seed", "before", "after", "lo", "hi"]


def _edge(t: pa.Table) -> pa.RecordBatch:
    n, t = t.num_rows, t.combine_chunks()
    cols = [t.column("ctx").combine_chunks(), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([True] * n), *(t.column(c).combine_chunks() for c in ("seed", "before", "after", "lo", "hi"))]
    return pa.RecordBatch.from_arrays(cols, names=_EDGE)


def repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, end, n_words: the spans, in words, that passages of at least 50 words found in another row cover.

    Words are runs without white space, A-Z lower-cased. Spans of a row don't touch each other. Rows of equal words repeat
    each other as a whole if they have 50 words. Each row is a document of its own, so a repeated row is a copy. doc_id may
    have any type and be null. Null, empty and shorter texts give no row, nor does an empty table; a text of any length is
    read as a whole; other columns are not read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("rid", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    rows = materialise(suffixes(slim), "suffixes").filter(F.col("n") >= LEAST)
    reps = materialise(rows.groupBy("node", "check").agg(F.min("rid").alias("rid"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("doc_id").alias("doc_id")), "reps")
    few = reps.count() <= BROADCAST_ROWS
    hint = reps.select("node", "check", "rid")
    own = rows.join(F.broadcast(hint) if few else hint, ["node", "check", "rid"], "left_semi")
    post = own.select("node", "check", F.explode(F.arrays_zip("at", "seeds")).alias("x")).select("node", "check", F.col("x.at").alias("pos"), F.col("x.seeds").alias("seed"))
    once = own.select("node", F.explode(F.array_distinct("seeds")).alias("seed"))
    shared = once.groupBy("seed").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("seed", "n")
    shared = materialise(shared, "shared")
    met = spread_join(post, shared.select("seed"), "seed", hot_keys(shared, "seed"), "node", "left_semi").groupBy("node", "check").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    need = met.join(hint, ["node", "check"]).select("rid", "node", "check", "at")
    written = materialise(contexts(slim.select("rid", "text").join(need, "rid")), "contexts")
    full = written.withColumn("ctx", F.xxhash64("seed", "before", "after"))
    table = full.groupBy("ctx", "seed", "before", "after").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    table = materialise(table, "table")
    equal = table.filter("lo <> hi").select("ctx", (F.length("before") / 4).cast("int").alias("left"), (F.length("after") / 4).cast("int").alias("right"))
    equal = equal.filter(F.col("left") + F.col("right") + SEED >= LEAST)
    large = materialise(table.groupBy("seed").count().filter(F.col("count") > NEIGHBOURS + 1).select("seed", F.col("count").alias("n")), "large")
    if large.count() <= BROADCAST_ROWS:
        mark = F.broadcast(large.select("seed"))
        seldom, many = table.join(mark, "seed", "left_anti"), table.join(mark, "seed", "left_semi")
    else:
        hot = hot_keys(large, "seed")
        seldom = materialise(spread_join(table, large.select("seed"), "seed", hot, "ctx", "left_anti"), "seldom")
        many = materialise(spread_join(table, large.select("seed"), "seed", hot, "ctx", "left_semi"), "many")
    found = equal.unionByName(neighbours(seldom, ("seed", "after", "before", "ctx"))).unionByName(grouped(many))
    reach = materialise(found.groupBy("ctx").agg(F.max("left").alias("left"), F.max("right").alias("right")), "reach")
    copies = full.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))
    met = spread_join(full.select("node", "check", "pos", "last", "ctx"), reach, "ctx", hot_keys(copies, "ctx"), "node")
    span = met.select("node", "check", (F.col("pos") - F.col("left")).alias("s"), (F.col("last") + SEED + F.col("right")).alias("e"))
    # overlapping spans of a class become one: a span starts anew where it lies behind the furthest end so far
    place = Window.partitionBy("node", "check").orderBy("s", "e")
    far = F.max("e").over(place.rowsBetween(Window.unboundedPreceding, -1))
    runs = span.withColumn("new", F.when(far >= F.col("s"), 0).otherwise(1)).withColumn("run", F.sum("new").over(place))
    lone = reps.filter("copies = 1").select("node", "check", "doc_id")  # of one row each, so the doc_id is that row's
    own = rows.select("doc_id", "node", "check")
    merged = materialise(runs.groupBy("node", "check", "run").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("run"), "spans")
    discard(shared, written, table, large, reach)
    parts = merged.join(lone, ["node", "check"])
    copied = reps.filter("copies > 1").select(F.struct("node", "check").alias("key"), F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), F.col("copies").alias("n"))
    every = own.select("doc_id", F.struct("node", "check").alias("key"))
    # rows of a class are alike but for the doc_id, so it deals them
    whole = every.join(F.broadcast(copied.drop("n")), "key") if few else spread_join(every, copied.drop("n"), "key", hot_keys(copied.select("key", "n"), "key"), "doc_id")
    out = parts.select("doc_id", "start", "end").unionByName(whole.select("doc_id", "start", "end"))
    return out.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
