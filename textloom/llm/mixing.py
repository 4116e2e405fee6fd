"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). On the driver, a small
network routes token capacity from patterns to source quotas; using the tokens of a pattern again costs more each time
(convex repetition costs), so the flow repeats nothing while fresh tokens are left. The flow of each (pattern, layer) is
then turned into documents by a seeded order: the place where its tokens run out is found by prefix sums over buckets of the
hash, and inside the bucket that is cut by those of the next level, until so few rows are left that they can be ordered. No
source is ever ordered in one task, whatever its size.

The driver holds one row per pattern and cut, never rows per document.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import SPACES, materialise

BUCKET_BITS, LEVELS = 12, 5  # of the seeded hash at each level of the search for a cut; 60 bits in all
EDGE_ROWS = 2000  # rows that may be ordered one by one around a cut; a bucket of more is cut into 2^12 others


def word_count(text):
    """Number of runs of other characters than white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACES}]+")).cast("long")


def water_fill(total: float, weights: dict, caps: dict) -> dict:
    """Share total by weight; shares stop at their cap and the excess is reshared by weight until none is above."""
    got, open_, left = {}, set(weights), float(total)
    while open_:
        w = sum(weights[k] for k in sorted(open_, key=str))
        over = {k for k in open_ if left * weights[k] / w > caps[k]}
        if not over:
            return got | {k: left * weights[k] / w for k in open_}
        for k in over:
            got[k] = float(caps[k])
        left -= sum(caps[k] for k in over)
        open_ -= over
    return got


def code_point_order(names):
    """Source names by code point, null last."""
    return sorted(names, key=lambda s: (s is None, [*map(ord, s or "")]))


def source_targets(sizes: dict, weights=(3, 1, 2), share: float = 1.5, repeat: int = 2) -> dict:
    """Targets of sources: weights repeat over the names by code point (null last), share of all sizes, at most repeat times the source."""
    names = code_point_order(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    return water_fill(share * sum(sizes.values()), w, {s: repeat * sizes[s] for s in names})


def min_cost_flow(capacity: dict, members: dict, quota: dict, layers: int = 2) -> dict:
    """Tokens that each (pattern, source, layer) sends.

    capacity: tokens of a pattern; members: its sources; quota: whole tokens a source asks for. Layer i of a pattern has the
    same capacity at cost i + 1 (convex), and feeds all sources of the pattern. Successive shortest paths with potentials,
    over node ids; saturating augmentations, so their number is bounded by the arcs and not by the tokens.
    """
    layer_ids = [(p, i) for p in sorted(capacity, key=str) for i in range(layers)]
    node = {"S": 0, "T": 1}
    for x in layer_ids:
        node["L", x] = len(node)
    for s in sorted(quota, key=str):
        node["Q", s] = len(node)
    to, cap, cost, out = [], [], [], [[] for _ in node]

    def arc(a, b, c, w):
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
        return len(to) - 2

    sent = {}
    for p, i in layer_ids:
        arc(0, node["L", (p, i)], int(capacity[p]), i + 1)
        for s in members[p]:
            if s in quota:
                sent[p, s, i] = arc(node["L", (p, i)], node["Q", s], int(capacity[p]), 0)
    for s, q in quota.items():
        arc(node["Q", s], 1, int(q), 0)
    pot = [0] * len(node)
    while True:
        dist, via, heap = [None] * len(node), [None] * len(node), [(0, 0)]
        dist[0] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if cap[e] > 0 and (dist[to[e]] is None or d + cost[e] + pot[x] - pot[to[e]] < dist[to[e]]):
                    dist[to[e]], via[to[e]] = d + cost[e] + pot[x] - pot[to[e]], e
                    heapq.heappush(heap, (dist[to[e]], to[e]))
        if dist[1] is None:
            break
        far = max(d for d in dist if d is not None)
        pot = [p + (far if d is None else d) for p, d in zip(pot, dist, strict=True)]
        # a blocking step over all arcs of reduced cost 0 keeps the number of Dijkstra rounds at the number of distinct path costs
        while path := _path(out, to, cap, cost, pot):
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push
    return {k: cap[e ^ 1] for k, e in sent.items() if cap[e ^ 1] > 0}


def _path(out, to, cap, cost, pot):
    """Arcs of one S-T path of reduced cost 0, or None."""
    via, stack = {0: None}, [0]
    while stack:
        x = stack.pop()
        if x == 1:
            arcs = []
            while via[x] is not None:
                arcs.append(via[x])
                x = to[via[x] ^ 1]
            return arcs
        for e in reversed(out[x]):
            if cap[e] > 0 and to[e] not in via and cost[e] + pot[x] - pot[to[e]] == 0:
                via[to[e]] = e
                stack.append(to[e])
    return None


def components(members: dict) -> list[list]:
    """Patterns that share sources, directly or not, grouped."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for p, sources in members.items():
        for s in sources:
            root[find(("s", s))] = find(("p", p))
    groups = {}
    for p in members:
        groups.setdefault(find(("p", p)), []).append(p)
    return list(groups.values())


def route(sizes: dict, members: dict, quota: dict, layers: int) -> dict:
    """min_cost_flow by component: {(pattern, layer): tokens}, summed over sources."""
    flow: dict = {}
    for group in components(members):
        own = {s for p in group for s in members[p]}
        part = min_cost_flow({p: sizes[p] for p in group}, {p: members[p] for p in group}, {s: quota[s] for s in own if s in quota}, layers)
        for (p, _, i), n in part.items():
            flow[p, i] = flow.get((p, i), 0) + n
    return flow


def mix(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", sources=None, weights=(3, 1, 2), share: float = 1.5, repeat: int = 2, seed: int = 7, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Select words of documents so that each source comes to its target.

    sources: an array column of the sources that a document belongs to (default: the one in column `source`, null being a
    source of its own; an empty array belongs to none and is never taken). Result: (doc_id, sources, size, taken and the columns `extra`), one row per
    row of docs, and (source, source_size, target); taken is at most repeat times size. The seeded order takes whole documents; the one document at the end of
    a (pattern, layer) is taken in part, so the words taken meet the flow exactly. Null or empty texts have size 0 and taken
    0. Repeated rows are documents of their own; rows of one id and size stand in the order of their texts' hashes, and rows of one text too are interchangeable. An empty table gives an
    empty result. Column names beside those named play no part.
    """
    src = F.array(F.col("source")) if sources is None else sources
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.array_distinct(src).alias("sources"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie"), F.struct(F.lit(0).alias("_"), *extra).alias("extra"))
    slim = slim.withColumn("pattern", F.to_json(F.struct(F.array_sort("sources").alias("s")), {"ignoreNullFields": "false"}))
    # rows without an id are told apart by their texts, else they would all have one place in the order
    slim = slim.withColumn("h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string"))), "size"))
    slim = materialise(slim.withColumn("h", F.shiftrightunsigned("h", 64 - BUCKET_BITS * LEVELS)), "mix")
    totals = slim.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("sources").alias("sources")).collect()
    sizes, members = {r.pattern: r["size"] for r in totals}, {r.pattern: r.sources for r in totals}
    by_source: dict = {}
    for p, names in members.items():
        for s in names:
            by_source[s] = by_source.get(s, 0) + sizes[p]
    targets = source_targets(by_source, weights, share, repeat)
    flow = route(sizes, members, {s: round(t) for s, t in targets.items()}, repeat)
    spark = docs.sparkSession
    goal = spark.createDataFrame([(s, float(by_source[s]), float(t)) for s, t in targets.items()], "source string, source_size double, target double")
    asked = {p: [int(flow.get((p, i), 0)) for i in range(repeat)] for p in members}
    cuts = find_cuts(slim, sizes, asked)
    place = "array<struct<asked:long,shift:int,bucket:long,before:long>>"
    known = F.broadcast(spark.createDataFrame([(p, cuts[p]) for p in members], f"pattern string, cuts {place}"))  # a row per pattern
    # before the bucket that is cut a document is taken whole, behind it not at all; inside it documents are ordered
    at = F.expr("transform(cuts, c -> shiftrightunsigned(h, c.shift) - c.bucket)")
    dealt = slim.join(known, "pattern").withColumn("at", at)
    on_edge = F.exists("at", lambda x: x == 0)
    flat = dealt.filter(~on_edge).withColumn("taken", F.expr("size * aggregate(at, 0, (a, x) -> a + IF(x < 0, 1, 0))"))
    edge = dealt.filter(on_edge)
    order = Window.partitionBy("pattern").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.lit(0)
    for i in range(repeat):
        cut, here = F.col("cuts")[i], F.col("at")[i]
        passed = cut["before"] + F.coalesce(F.sum(F.when(here == 0, F.col("size")).otherwise(0)).over(order), F.lit(0))
        part = F.greatest(F.lit(0), F.least(F.col("size"), cut["asked"] - passed))
        taken = taken + F.when(here < 0, F.col("size")).when(here == 0, part).otherwise(0)
    edge = edge.withColumn("taken", taken)
    cols = ["doc_id", "sources", "size", F.col("taken").cast("long").alias("taken"), *(F.col("extra")[c].alias(c) for c in extra)]
    return flat.select(cols).unionByName(edge.select(cols)), goal


def find_cuts(slim: DataFrame, sizes: dict, asked: dict) -> dict:
    """Per pattern, and for each of its layers, (asked, shift, bucket, before): the tokens asked for run out in the rows whose h >> shift is bucket, `before` stand before them.

    slim: (pattern, h, size), h of BUCKET_BITS * LEVELS bits. A layer that takes all or nothing is cut before the first or
    behind the last bucket.
    """
    spark, width = slim.sparkSession, BUCKET_BITS * LEVELS
    found = {p: [(a, width - BUCKET_BITS, -1 if a <= 0 else 1 << BUCKET_BITS, 0) for a in layers] for p, layers in asked.items()}
    open_ = [(p, i, a, width, 0, 0) for p, layers in asked.items() for i, a in enumerate(layers) if 0 < a < sizes[p]]
    for level in range(1, LEVELS + 1):
        if not open_:
            break
        # buckets of this level inside the one that is cut; prefix sums over 2^BUCKET_BITS of them
        shift = width - BUCKET_BITS * level
        cut = F.broadcast(spark.createDataFrame(open_, "pattern string, layer int, asked long, up int, parent long, before long"))
        inside = slim.select("pattern", "h", "size").join(cut, "pattern").filter(F.expr("shiftrightunsigned(h, up)") == F.col("parent"))
        sums = inside.groupBy("pattern", "layer", "asked", "before", F.expr(f"shiftrightunsigned(h, {shift})").alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        ahead = F.sum("words").over(Window.partitionBy("pattern", "layer").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.col("before") + F.coalesce(ahead, F.lit(0)))
        rows = sums.filter("before < asked AND asked <= before + words").collect()  # one bucket per pattern and layer
        for r in rows:
            found[r.pattern][r.layer] = (r.asked, shift, r.bucket, r.before)
        open_ = [(r.pattern, r.layer, r.asked, shift, r.bucket, r.before) for r in rows if r.n > EDGE_ROWS]
    return found
