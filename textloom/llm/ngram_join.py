"""Exact n-gram Jaccard join by vertical partitioning, and the components of its links.

A document is the set of its word n-grams, as 64-bit hashes. Equal sets are one class (known by 128 bits) and are joined once.
All n-grams stand in one global order, common ones last; the order is cut into fragments, and a class becomes one segment per
fragment, a row of its own.

1. Candidates: two classes of Jaccard t share at least SHARED of the first  n - ceil(t n) + SHARED  n-grams of each in the
   global order, so only these prefixes are spread out. Sizes and positions rule out more.
2. Counts: fragment after fragment, a pair meets the two segments of its classes in that fragment, and what they share is added
   to the pair's sum. A pair that can't come to the threshold with what its classes hold in later fragments is counted no further.

Groups of near copies are not expanded into all pairs. First every class is paired with the smallest class of its n-gram's
bucket only (a star); classes that these links connect need no further comparison. Then all pairs of classes of one bucket
that are still in different components are counted. No candidate is dropped, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, hot_keys, materialise, release, sorted_join, spread_join

PERCENT, N = 85, 4
SHARED = 2  # n-grams of the prefixes that a linked pair shares at least
FRAGMENTS = 4  # 3 of the order's front, by hash; the last holds the common n-grams
#: The order needs to know common n-grams; any order gives the same result, so they are estimated from one document in 16.
ORDER_SHARE, ORDER_LEAST, ORDER_MOST = 16, 2, 1 << 20
PAIR_SHARE = 64  # a bucket of over 1/64 of all places is cut for the search of its pairs
BROADCAST_ROWS = 1 << 21  # of 8 or 16 bytes; beyond it, Spark's own choice of join
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 5)
        return got


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, memo: _Words, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, one of the whole; of none, none."""
    words = raw.translate(_LOWER).split()  # bytes.split() splits at U+0009 to U+000D and space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((memo[w] for w in words), np.uint64, len(words))
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xFF51AFD7ED558CCD) + _finish(h[i : i + len(total)] * _MULTIPLIERS[i % 8] + np.uint64(i))
    return np.unique(_finish(total))


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT, shared: int = SHARED) -> int:
    return min(n, n - -(-percent * n // 100) + shared)


class Order:
    """The global order: n-grams not known as common by hash, then the common ones, rarest first."""

    def __init__(self, common: np.ndarray, rank: np.ndarray):
        by = np.argsort(common)
        self.common, self.rank = common[by], rank[by]

    def split(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The front and the back (common) part of a sorted set, both in order."""
        if not len(self.common) or not len(grams):
            return grams, grams[:0]
        at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
        hit = self.common[at] == grams
        return grams[~hit], grams[hit][np.argsort(self.rank[at[hit]], kind="stable")]

    def prefix(self, grams: np.ndarray, k: int) -> np.ndarray:
        front, back = self.split(grams)
        return front[:k] if len(front) >= k else np.concatenate([front, back[: k - len(front)]])

    def segments(self, grams: np.ndarray) -> list[np.ndarray]:
        """The set cut into FRAGMENTS parts of the order."""
        front, back = self.split(grams)
        cut = np.searchsorted(front, [np.uint64((i << 64) // (FRAGMENTS - 1)) for i in range(1, FRAGMENTS - 1)])
        return [*np.split(front, cut), back]


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(i)]


def find_order(slim: DataFrame, n: int = N) -> Order:
    """Common n-grams of a sample of documents, at most ORDER_MOST of them. They steer the cost, never the result."""
    picked = slim.filter(F.pmod(F.xxhash64(F.lit(41), "rid", F.length("text")), F.lit(ORDER_SHARE)) == 0)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            sets = [shingles(t, memo, n) for t in _texts(batch, 1)]
            if sets:
                g, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=["g", "c"])

    found = picked.select("rid", "text").mapInArrow(grams, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).filter(F.col("c") >= ORDER_LEAST)
    got = found.orderBy(F.desc("c"), "g").limit(ORDER_MOST).toPandas()
    common = got["g"].to_numpy(np.int64).view(np.uint64).copy()
    del got
    release()
    return Order(common, np.arange(len(common), 0, -1))


def sign_of(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    got = xxhash.xxh3_128_intdigest(grams.tobytes())
    high, low = got >> 64, got & (1 << 64) - 1
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


def classes(slim: DataFrame, order, n: int, percent: int) -> DataFrame:
    """(rid, doc_id, n, node, check, prefix) of every row: node and check are hashes of the set, 0 shingles give a null node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, by = _Words(), order.value
        for batch in batches:
            sizes, nodes, checks, prefixes = [], [], [], []
            for t in _texts(batch, 1):
                grams = shingles(t, memo, n)
                sizes.append(len(grams))
                node, check = sign_of(grams) if len(grams) else (None, None)
                nodes.append(node)
                checks.append(check)
                prefixes.append(by.prefix(grams, prefix_length(len(grams), percent)).view(np.int64))
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32))
            cols = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "n", "node", "check", "prefix"])
        del memo
        release()

    kind = dict(slim.dtypes)["doc_id"]
    return slim.select("rid", "text", "doc_id").mapInArrow(run, f"rid long, doc_id {kind}, n long, node long, check long, prefix array<long>")


def known_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and (node, rid, n, k): one row that stands for each class, and the class's rows. Sets of equal node but different check get nodes of their own."""
    reps = materialise(rows.filter("node IS NOT NULL").groupBy("node", "check").agg(F.min("rid").alias("rid"), F.min("n").alias("n"), F.count(F.lit(1)).alias("k")), "reps")
    twice = reps.groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("twice"))
    if not twice.head(1):
        return rows, reps.drop("check")
    node = F.when(F.col("twice"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    again = lambda df: df.join(F.broadcast(twice), "node", "left").withColumn("node", node).drop("twice")  # noqa: E731  # a handful of all rows
    return again(rows), again(reps).drop("check")


def segments(texts: DataFrame, order, n: int) -> DataFrame:
    """(node, fragment, part, after) of rows (node, text): the set's n-grams in each fragment, and how many it holds in later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, by = _Words(), order.value
        for batch in batches:
            parts, after = [], []
            for t in _texts(batch, 1):
                own = by.segments(shingles(t, memo, n))
                parts += [g.view(np.int64) for g in own]
                after += np.cumsum([0, *(len(g) for g in own[:0:-1])])[::-1].tolist()
            flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32))
            nodes = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), FRAGMENTS)))
            fragment = pa.array(np.tile(np.arange(FRAGMENTS), batch.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([nodes, fragment, pa.ListArray.from_arrays(ends, flat), pa.array(after, pa.int64())], names=["node", "fragment", "part", "after"])
        del memo
        release()

    return texts.select("node", "text").mapInArrow(run, "node long, fragment int, part array<long>, after long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the table has few enough rows of a few numbers."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def overlaps(pairs: DataFrame, slim: DataFrame, reps: DataFrame, order, n: int, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are linked. Texts are read again for the classes that occur only; pairs is a written table."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    need = materialise(ends.distinct().join(reps, "node").select("rid", "node"), "need")
    n_need = need.count()
    texts = slim.join(_small(need, n_need), "rid").select("node", "text")
    seg = materialise(segments(texts, order, n), "segments")
    done, found = [need, seg], pairs.withColumn("sum", F.lit(0).cast("long"))
    hot = {c: hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c) for c in ("a", "b")}
    if seg.count() > n_need * FRAGMENTS:  # rows alike in id and text
        seg = seg.dropDuplicates(["node", "fragment"])
    for i in range(FRAGMENTS):
        part = seg.filter(F.col("fragment") == i)
        for c, other in (("a", "b"), ("b", "a")):  # a class of very many pairs is dealt over many tasks
            own = part.select(F.col("node").alias(c), F.col("part").alias("p" + c), F.col("after").alias("after" + c))
            found = spread_join(found, own, c, hot[c], other)
        found = found.withColumn("sum", F.col("sum") + F.size(F.array_intersect("pa", "pb")))
        most = F.col("sum") + F.least("aftera", "afterb")
        found = found.filter(most * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb", "sum")
    found = materialise(found, "linked")
    discard(*done)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (u, v): root is the smallest node connected. Alternating large and small stars, written at each round, until a round changes nothing."""
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        # the large star leads a node's larger neighbours to the smallest one, the small star its smaller ones
        large = spread_join(both, low.drop("n"), "u", hot_keys(low.select("u", "n"), "u"), "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sorted_join(least), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        old, e = e, materialise(small, "edges")
        # done when every node that leads to another leads to one only, to which none but such edges lead
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("leads"), F.lit(0).alias("led")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("leads"), F.lit(1).alias("led")))
        if not ends.groupBy("x").agg(F.sum("leads").alias("leads"), F.max("led").alias("led")).filter("leads > 1 OR leads > 0 AND led > 0").head(1):
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        discard(old)


def links(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, node) and the components (node, root) of the classes that have links."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    slim = slim.withColumn("rid", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    order = spark.sparkContext.broadcast(find_order(slim, n))
    written = materialise(classes(slim, order, n, percent), "classes")
    rows, reps = known_classes(written)
    n_reps = reps.count()
    own = rows.join(_small(reps.select("node", "rid"), n_reps), ["node", "rid"], "left_semi")
    if own.count() > n_reps:  # rows alike in id and text
        own = own.dropDuplicates(["node"])
    # sets of fewer than percent / (100 - percent) n-grams are linked with equal ones only
    post = own.filter(F.col("n") * (100 - percent) >= percent).select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    # an n-gram of one class only can't be shared. The hub of a bucket is the class with the fewest rarer n-grams, so the most central one
    star = post.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("pos", "node")).alias("hub")).filter("k > 1")
    star = materialise(star.select("gram", F.col("hub.node").alias("hub"), F.col("k").alias("n")), "star")
    met = spread_join(post, star.drop("n"), "gram", hot_keys(star, "gram"), "node")
    before = Window.partitionBy("node").orderBy("pos")
    met = materialise(met.withColumn("live", F.row_number().over(before) - 1), "met")
    hubs = met.filter("node <> hub").groupBy("node", "n", "hub").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= SHARED)
    spokes = hubs.groupBy("node", "n").agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("hub"))
    sizes = reps.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    spokes = spokes.join(F.broadcast(sizes) if n_reps <= BROADCAST_ROWS else sizes, "hub").filter(F.least("n", "hub_n") * 100 >= percent * F.greatest("n", "hub_n"))
    low = F.col("node") < F.col("hub")
    spokes = spokes.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.when(low, F.col("n")).otherwise(F.col("hub_n")).alias("na"), F.when(low, F.col("hub_n")).otherwise(F.col("n")).alias("nb")).distinct()
    spokes = materialise(spokes, "spokes")
    first = overlaps(spokes, slim, reps, order, n, percent)
    edge = lambda pairs: pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    comp = materialise(components(edge(first)), "components")
    # what is left: pairs of one bucket in different components
    at = met.join(sorted_join(comp), "node", "left").select("gram", "node", "n", "pos", "live", F.coalesce("root", "node").alias("comp"))
    many = at.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo <> hi").select("gram", F.col("k").alias("n"))
    many = materialise(many, "many")
    at = spread_join(at, many.drop("n"), "gram", hot_keys(many, "gram"), "node", "left_semi")
    # n-grams are met as 32-bit hashes from here on: equal ones stay equal, and every pair found is counted afterwards. The n-grams
    # of a class's prefix, in order: a pair is met at its first common one, and only there
    own = Window.partitionBy("node").orderBy("pos")
    at = at.withColumn("gram", F.hash("gram")).withColumn("live", F.row_number().over(own) - 1)
    at = at.withColumn("grams", F.collect_list("gram").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # n-grams of a set with one 32-bit hash count once where lists are intersected: twins are how many more a set holds
    at = at.withColumn("twins", F.size("grams") - F.size(F.array_distinct("grams")))
    at = materialise(at.filter(F.size("grams") >= SHARED), "apart")
    buckets = hot_keys(at.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", PAIR_SHARE)
    x, y = (at.select("gram", *(F.col(c).alias(c + s) for c in ("node", "n", "pos", "live", "comp", "grams", "twins"))) for s in "xy")
    apart = (F.col("nodex") < F.col("nodey")) & (F.col("compx") != F.col("compy"))
    # what the sets can share at most: of what stands before the n-gram that they meet on, and from there on
    most = F.least("livex", "livey") + F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy"))
    close = F.least("nx", "ny") * 100 >= percent * F.greatest("nx", "ny")
    fits = lambda overlap: overlap * (100 + percent) >= percent * (F.col("nx") + F.col("ny"))
    first_met = ~F.arrays_overlap(F.slice("gramsx", F.lit(1), F.col("livex")), F.slice("gramsy", F.lit(1), F.col("livey")))
    # all n-grams shared up to the earlier end of the two prefixes are counted; behind it stand as many as the longer rest at most
    shared = F.size(F.array_intersect("gramsx", "gramsy")) + F.greatest("twinsx", "twinsy")
    behind = F.greatest(*(F.col(c) - _prefix(c, percent) for c in ("nx", "ny")))
    # the pairs of a large bucket are dealt over tasks by their first class
    rest = spread_join(x, y, "gram", buckets, "nodex", where=apart & close & fits(most) & first_met & (shared >= SHARED) & fits(shared + behind))
    rest = rest.select(F.col("nodex").alias("a"), F.col("nodey").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb")).distinct()
    rest = materialise(rest.join(sorted_join(spokes), ["a", "b"], "left_anti"), "rest")
    discard(star, met, many, at)
    second = overlaps(rest, slim, reps, order, n, percent)
    found = materialise(components(edge(first).unionByName(edge(second))), "components")
    discard(spokes, first, comp, rest, second)
    return rows.select("doc_id", "n", "node"), found


def _prefix(n: str, percent: int):
    """prefix_length as a column."""
    return F.least(F.col(n), F.col(n) + F.floor(F.lit(-percent) * F.col(n) / 100).cast("long") + SHARED)


def join_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included); one row per row of docs.

    Each row is a document of its own; doc_id may have any type that has an order. Null texts and texts without words have no
    shingles and are linked with nothing; a null doc_id takes part in links and gives no component_id. A text of any length
    is read as a whole; repeated rows are linked with each other. An empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    rows, comp = links(docs, text=text, doc_id=doc_id, n=n, percent=percent)
    lone = rows.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    least = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    by_root = least.join(sorted_join(comp), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "n")
    by_root = materialise(by_root, "rooted")
    # a class's smallest doc_id, then a component's; what goes back to the rows is one row a class
    top = by_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = spread_join(by_root.select("node", "root"), top.drop("n"), "root", hot_keys(top.select("root", "n"), "root"), "node").select("node", "component_id")
    out = spread_join(rows.filter("node IS NOT NULL"), named, "node", hot_keys(by_root.select("node", "n"), "node"), "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(lone)
