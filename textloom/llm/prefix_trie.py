"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a sequence of turns, each known by 16 bytes of its SHA-256. Equal sequences enter once, with their number of
copies.

1. Runs: each task sorts blocks of sequences and writes them as runs. A run's row holds the number of leading turns that a sequence shares
   with the one before it (its LCP) and only the turns behind them. Runs are cut at splitters taken from a sample, so that each
   part of the order is merged by a task of its own.
2. Merge: a loser tree merges the runs of a part. Its players know how many turns they share with the last winner, so two players
   are compared from the turn on where both stop agreeing with it, and not at all where one of them agrees longer.
3. Nodes: the merged stream keeps the path that is open as a stack. What the next sequence doesn't share is finished: its counts are added
   to its parent and its row is emitted.

A node that leads to a splitter may have members in several parts. Such nodes are at most as many as the splitters have turns; the parts
emit their shares, which are summed, and the smallest members go to their children by a join.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import hot_keys, materialise, release, spread_join

WIDTH = 16  # bytes of a turn's key
BLOCK, SHARED_TURNS = 100, 6
#: A run ends at so many sequences or bytes of keys; a part of the order is to hold about so many bytes of keys.
RUN_ROWS, RUN_BYTES, PART_BYTES = 1 << 16, 16 << 20, 32 << 20
#: Splitters come from so many sequences at about, of which so many turns are looked at. They steer the sizes of the parts, never the result.
SAMPLE, SAMPLE_TURNS = 2048, 256
PIECE = 1 << 18  # bytes of ids put together before they are sent
BROADCAST_ROWS = 1 << 17

_PARTIAL = "part int, run string, lcp array<int>, tail array<binary>, lens array<array<long>>, copies array<long>, least array<long>, ends array<string>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, last_len long, cut int, parent_cut int"
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NOBODY = hashlib.sha256(b"").hexdigest()


# ---- sequences


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns is an array of (turn, key, len), in order; key is the hex form of 16 bytes. Turns of one number stand in the order of their keys."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.length(text).cast("long").alias("len")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the block's first conversation, then the conversation's own turns after its first h; h is crc32 of the number mod 6."""
    c = turns.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    heads = turns.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_TURNS - 1).alias("head"))
    both = c.join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def sequences(rebuilt: DataFrame) -> DataFrame:
    """(node, keys, lens, copies, least, ends) of the distinct sequences: ends is the SHA-256 of their conversations' numbers in order, comma-joined."""
    hexed = F.array_join(F.transform("turns", lambda t: t["key"]), "")
    rows = materialise(rebuilt.select("conv_id", F.unhex(hexed).alias("keys"), F.transform("turns", lambda t: t["len"]).alias("lens")).withColumn("node", F.unhex(F.sha2("keys", 256))), "sequences")
    found = rows.groupBy("node").agg(F.any_value("keys").alias("keys"), F.any_value("lens").alias("lens"), F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("least"))
    found = materialise(found, "distinct")
    # numbers of a large group are joined in pieces by many tasks; the last one only streams the pieces through the hash
    many = found.filter("copies > 1").select("node", F.col("copies").alias("n"))
    grouped = spread_join(rows.select("node", "conv_id"), many.select("node"), "node", hot_keys(many, "node"), "conv_id", "left_semi")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids, held = None, None, [], 0
        row = lambda: pa.RecordBatch.from_pylist([{"node": now, "first": first, "ids": ",".join(ids)}], schema=piece)
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now or held > PIECE:
                    if ids:
                        yield row()
                    now, first, ids, held = node, conv, [], 0
                ids.append(str(conv))
                held += len(ids[-1])
        if ids:
            yield row()

    piece = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        row = lambda: pa.RecordBatch.from_pylist([{"same": now, "ends": state.hexdigest()}], schema=digest)
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != now:
                    if state:
                        yield row()
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield row()

    digest = pa.schema([("same", pa.binary()), ("ends", pa.string())])
    cut = grouped.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, first long, ids string")
    whole = cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "same binary, ends string")
    out = found.join(whole, F.col("node") == F.col("same"), "left").drop("same")
    return out.withColumn("ends", F.coalesce("ends", F.sha2(F.col("least").cast("string").cast("binary"), 256)))


# ---- runs


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """The number of leading turns that two sequences share, if they share `start` of them. Doubling steps, then halving ones."""
    most = min(len(a), len(b)) // WIDTH
    low, step = start, 1
    while low < most and a[low * WIDTH : (low + step) * WIDTH] == b[low * WIDTH : (low + step) * WIDTH] and low + step <= most:
        low, step = low + step, 2 * step
    while step:
        if low + step <= most and a[low * WIDTH : (low + step) * WIDTH] == b[low * WIDTH : (low + step) * WIDTH]:
            low += step
        step //= 2
    return low


def splitters(seqs: DataFrame, rows: int, size: int) -> list[bytes]:
    """Sequences that cut the order into parts of about PART_BYTES, or one for each shuffle partition if these are smaller."""
    parts = min(max(-(-size // PART_BYTES), int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), SAMPLE // 2)
    each = max(1, rows // SAMPLE)
    picked = seqs.filter(F.pmod(F.xxhash64("node"), F.lit(each)) == 0).select(F.substring("keys", 1, WIDTH * SAMPLE_TURNS).alias("k"), F.xxhash64("node").alias("h"))
    sample = sorted({bytes(r.k) for r in picked.orderBy("h").limit(2 * SAMPLE).collect()} - {b""})
    cuts = []
    for i in range(1, parts):
        at = i * len(sample) // parts
        if 0 < at < len(sample):  # the shortest that still parts it from the one before
            cut = sample[at][: WIDTH * (shared(sample[at - 1], sample[at]) + 1)]
            if not cuts or cut > cuts[-1]:
                cuts.append(cut)
    return cuts


def write_runs(seqs: DataFrame, cuts: list[bytes]) -> DataFrame:
    """The sorted runs, a row for each run and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda r: r[0])
            name = hashlib.sha256(b"".join(r[0][:64] for r in held[:1])).hexdigest() + f"-{number}"
            lo = 0
            while lo < len(held):
                part = bisect_right(cuts, held[lo][0])
                hi = lo + 1
                end = cuts[part] if part < len(cuts) else None
                while hi < len(held) and (end is None or held[hi][0] < end):
                    hi += 1
                lcp = [0, *(shared(held[i - 1][0], held[i][0]) for i in range(lo + 1, hi))]
                rows = [(r[0][WIDTH * n :], r[1][n:], *r[2:]) for r, n in zip(held[lo:hi], lcp, strict=True)]
                columns = dict(zip(("tail", "lens", "copies", "least", "ends"), map(list, zip(*rows, strict=True)), strict=True))
                yield pa.RecordBatch.from_pylist([{"part": part, "run": name, "lcp": lcp} | columns], schema=schema)
                lo = hi

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.append(row)
                size += len(row[0])
                if len(held) >= RUN_ROWS or size >= RUN_BYTES:
                    yield from flush()
                    held, size, number = [], 0, number + 1
        yield from flush()
        held = []
        release()

    schema = pa.schema([("part", pa.int32()), ("run", pa.string()), ("lcp", pa.list_(pa.int32())), ("tail", pa.list_(pa.binary())), ("lens", pa.list_(pa.list_(pa.int64()))), ("copies", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("ends", pa.list_(pa.string()))])
    return seqs.select("keys", "lens", "copies", "least", "ends").mapInArrow(run, _PARTIAL)


# ---- merge


class Run:
    """A cursor over a sorted run: its sequence, and how many turns it shares with the last one that left the tree."""

    __slots__ = ("keys", "lens", "copies", "least", "ends", "lcp", "_rows")

    def __init__(self, lcp, tail, lens, copies, least, ends):
        self._rows = zip(lcp, tail, lens, copies, least, ends, strict=True)
        self.keys, self.lens = b"", []
        self.step()

    def step(self) -> None:
        row = next(self._rows, None)
        if row is None:
            self.keys = None
            return
        self.lcp = row[0]
        self.keys = self.keys[: WIDTH * self.lcp] + row[1]
        self.lens = self.lens[: self.lcp] + row[2]
        self.copies, self.least, self.ends = row[3:]


def _plays(a: Run, b: Run) -> tuple[Run, Run]:
    """Winner and loser. The loser's lcp becomes what it shares with the winner, which is the last one to leave the tree when the loser plays next."""
    if a.keys is None or b.keys is None:
        return (b, a) if a.keys is None else (a, b)
    if a.lcp != b.lcp:  # the one that agrees longer with the last winner comes first; the other's lcp holds for it too
        return (a, b) if a.lcp > b.lcp else (b, a)
    n = shared(a.keys, b.keys, a.lcp)
    at = WIDTH * n
    win, lose = (a, b) if a.keys[at : at + WIDTH] <= b.keys[at : at + WIDTH] else (b, a)
    lose.lcp = n
    return win, lose


def merged(runs: list[Run]) -> Iterator[Run]:
    """The runs' sequences in order. Loser tree: node i holds the loser of its match, the winner goes on; lcp of what is yielded refers to the one before."""
    k = len(runs)
    losers: list = [None] * k

    def build(i: int) -> Run:
        if i >= k:
            return runs[i - k]
        winner, losers[i] = _plays(build(2 * i), build(2 * i + 1))
        return winner

    top = build(1) if k > 1 else runs[0]
    at = {id(r): i + k for i, r in enumerate(runs)}
    while top.keys is not None:
        yield top
        i, top_ = at[id(top)] // 2, top
        top_.step()
        while i:
            top_, losers[i] = _plays(top_, losers[i])
            i //= 2
        top = top_


# ---- nodes


class _Open:
    """A node of the open path. kids holds its children's rows until its smallest member is known."""

    __slots__ = ("convs", "least", "children", "leaves", "saved", "ends", "length", "kids")

    def __init__(self, length: int):
        self.convs, self.least, self.children, self.leaves, self.saved, self.ends, self.length, self.kids = 0, None, 0, 0, 0, _NOBODY, length, []


def nodes_of(stream: Iterator[Run], left: bytes, right: bytes, name) -> Iterator[dict]:
    """Rows of the nodes of one part. name(depth, right): the number of a node that leads to the part's left or right splitter."""
    path = [_Open(0)]
    here = b""  # the sequence of the open path
    edge = (0, 0)  # turns that it shares with the splitters

    def finish(depth: int) -> Iterator[dict]:
        node = path.pop()
        cut = name(depth, edge[1] >= depth) if depth <= max(edge) else None
        row = {"conv_id": node.least, "depth": depth, "n_convs": node.convs, "ends_sha256": node.ends, "last_len": node.length, "cut": cut, "n_children": node.children, "parent_conv_id": None, "parent_cut": None}
        if cut is None:
            node.leaves += not node.children
            node.saved += (node.convs - 1) * node.length
        for kid in node.kids:
            yield kid | ({"parent_conv_id": node.least} if cut is None else {"parent_cut": cut})
        row |= {"n_leaves": node.leaves, "saved_tokens": node.saved}
        if path:
            up = path[-1]
            up.convs += node.convs
            up.least = node.least if up.least is None else min(up.least, node.least)
            if cut is None:
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
                up.kids.append(row)
                if len(up.kids) >= 4096 and depth - 1 <= max(edge):  # the parent leads to a splitter: its children needn't wait
                    waiting = name(depth - 1, edge[1] >= depth - 1)
                    yield from (kid | {"parent_cut": waiting} for kid in up.kids)
                    up.kids.clear()
                return
            row["parent_cut"] = name(depth - 1, edge[1] >= depth - 1)
        yield row

    for run in stream:
        for depth in range(len(path) - 1, run.lcp, -1):
            yield from finish(depth)
        here = run.keys
        edge = (shared(here, left), shared(here, right))
        path.extend(_Open(n) for n in run.lens[run.lcp :])
        top = path[-1]
        top.convs, top.ends = top.convs + run.copies, run.ends
        top.least = run.least if top.least is None else min(top.least, run.least)
    for depth in range(len(path) - 1, -1, -1):
        yield from finish(depth)


def merge_parts(runs: DataFrame, cuts: list[bytes]) -> DataFrame:
    """The nodes of every part; those that lead to a splitter (cut: the number of the node) with the part's share only."""
    # a node that leads to splitter i at a depth is named by the first splitter that leads to it too
    first, names, total = [], [], 0
    for i, cut in enumerate(cuts):
        depth = len(cut) // WIDTH
        same = shared(cuts[i - 1], cut) if i else -1
        own = [first[i - 1][d] if d <= same else total + d - same - 1 for d in range(depth + 1)]
        total += depth - min(same, depth)
        first.append(own)
    names = first or [[0]]

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        left, right = cuts[part - 1] if part else b"", cuts[part] if part < len(cuts) else b""
        near = names[min(part, len(names) - 1)], names[max(part - 1, 0)]
        name = lambda depth, is_right: near[0][depth] if is_right and part < len(cuts) else near[1][depth]
        columns = [table.column(c).to_pylist() for c in ("lcp", "tail", "lens", "copies", "least", "ends")]
        stream = merged([Run(*row) for row in zip(*columns, strict=True)])
        out, block = [], []
        for row in nodes_of(stream, left, right, name):
            block.append(row)
            if len(block) >= 8192:
                out.append(pa.Table.from_pylist(block, schema=schema))
                block = []
        out.append(pa.Table.from_pylist(block, schema=schema))
        return pa.concat_tables(out)

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(c, kinds[t]) for c, t in (x.split() for x in _NODE.split(", "))])
    tasks = max(len(cuts) + 1, 1)
    return runs.repartitionByRange(tasks, "part").groupBy("part").applyInArrow(merge, _NODE)


def join_cuts(spark: SparkSession, shares: list) -> DataFrame:
    """The nodes that lead to splitters, their shares summed. They are at most the splitters' turns times the parts beside them."""
    found: dict[int, dict] = {}
    for r in shares:
        x = found.setdefault(r.cut, {"depth": r.depth, "least": None, "convs": 0, "children": 0, "leaves": 0, "saved": 0, "ends": _NOBODY, "length": r.last_len, "parent": r.parent_cut})
        x["least"] = r.conv_id if x["least"] is None else min(x["least"], r.conv_id)
        x["convs"], x["children"], x["leaves"], x["saved"] = x["convs"] + r.n_convs, x["children"] + r.n_children, x["leaves"] + r.n_leaves, x["saved"] + r.saved_tokens
        x["ends"] = r.ends_sha256 if r.ends_sha256 != _NOBODY else x["ends"]
    for x in sorted(found.values(), key=lambda x: -x["depth"]):
        x["leaves"] += not x["children"]
        x["saved"] += (x["convs"] - 1) * x["length"]
        if x["parent"] is not None:
            up = found[x["parent"]]
            up["children"], up["leaves"], up["saved"] = up["children"] + 1, up["leaves"] + x["leaves"], up["saved"] + x["saved"]
    rows = [(cut, x["least"], x["depth"], None if x["parent"] is None else found[x["parent"]]["least"], x["convs"], x["children"], x["leaves"], x["saved"], x["ends"]) for cut, x in found.items()]
    fields = [("cut", T.IntegerType()), *((c, T.StringType() if c == "ends_sha256" else T.LongType()) for c in NODE_COLUMNS)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, t) for c, t in fields]))


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows of a null conv_id belong to no conversation and are left out; null turns come first, null roles and texts are empty. Turns of
    one number in a conversation stand in the order of their hashes, repeated rows are turns of their own. Equal conversations are
    members of the same nodes. A turn of any length is read as a whole; after that, a conversation is 16 bytes and a length for each of its
    turns, and one task holds those of a conversation. An empty table has no nodes, not even a root. Other columns are not read.
    """
    spark = conversations.sparkSession
    seqs = materialise(sequences(rebuild(materialise(turns_of(conversations), "turns"))), "classes")
    rows, size = seqs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("keys") + 64), F.lit(0))).first()
    cuts = splitters(seqs, rows, size)
    parts = materialise(merge_parts(materialise(write_runs(seqs, cuts), "runs"), cuts), "nodes")
    tops = join_cuts(spark, parts.filter("cut IS NOT NULL").collect())
    whole = parts.filter("cut IS NULL")
    out = whole.filter("parent_cut IS NULL").select(*NODE_COLUMNS)
    known = tops.select(F.col("cut").alias("parent_cut"), F.col("conv_id").alias("up"))
    known = F.broadcast(known) if tops.count() <= BROADCAST_ROWS else known
    below = whole.filter("parent_cut IS NOT NULL").join(known, "parent_cut").withColumn("parent_conv_id", F.col("up"))
    return out.unionByName(below.select(*NODE_COLUMNS)).unionByName(tops.select(*NODE_COLUMNS))
