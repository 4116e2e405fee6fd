"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

State of an index, as Parquet in a shared folder:
  refs     (shard, k1, k2, doc_id, n)     exact reference counts, one row per key and document, added up over versions
  active   (shard, k1, k2, n_docs, keeper)  keys found in at least min_docs documents, with the largest doc_id
  filters  (shard, n, blob)               a cuckoo filter per shard over its active keys

Inserting documents adds reference rows, deleting documents adds negative ones; the active keys of the shards touched
follow from them exactly, and keys that pass the threshold are inserted into or deleted from the shard's cuckoo filter.
A line meets its shard's filter first, at every size of the tables; the exact table then decides about those it holds.
A key is the pair of two 64-bit hashes of the normalised line.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import hot_keys, materialise, scratch_dir, spread_join
from textloom.sinks import finished_versions

MIN_CHARS, MIN_DOCS = 20, 3
KEYS_PER_SHARD = 1 << 16
#: Filters and exact keys of so many bytes (measured) may be sent to every task; beyond it lines are dealt to their shard's filter.
BROADCAST_BYTES = 48 << 20
SALTS = 64  # tasks over which a shard's lines are dealt
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WHITE = b" \t\n\x0b\x0c\r"


# -- keys --------------------------------------------------------------------------------------------------------------
def line_key(line):
    """Spark: the line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(_WHITE.decode()))
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_hashes(key):
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


_SECOND_SEED = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def python_keys(raw: bytes) -> tuple[int, int]:
    """The same two hashes of a normalised line, as signed 64-bit numbers."""
    a, b = xxhash.xxh64_intdigest(raw, 42), xxhash.xxh64_intdigest(raw, _SECOND_SEED)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def normalise(line: bytes) -> bytes:
    return line.strip(_WHITE).translate(_LOWER)


def n_code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))


# -- cuckoo filter -----------------------------------------------------------------------------------------------------
class CuckooFilter:
    """16-bit fingerprints in buckets of four; insertion, deletion, membership. Grows by rebuilding from the exact table."""

    SLOTS, KICKS = 4, 400

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        need = max(1, int(capacity / (self.SLOTS * 0.84)) + 1)
        self.buckets = 1 << (need - 1).bit_length() if table is None else len(table)
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16) if table is None else table

    @staticmethod
    def _mix(x):
        return (np.uint64(x) * np.uint64(0x9E3779B97F4A7C15)) if isinstance(x, np.ndarray) else (int(x) * 0x9E3779B97F4A7C15) & (2**64 - 1)

    def _place(self, k1: int, k2: int) -> tuple[int, int, int]:
        f = (k2 & 0xFFFF) or 1
        i = (k1 >> 8) & (self.buckets - 1)
        return f, i, i ^ ((self._mix(f) >> 40) & (self.buckets - 1))

    def insert(self, k1: int, k2: int) -> bool:
        """False if the filter is too full; the caller rebuilds it larger from the exact table."""
        f, i, j = self._place(k1, k2)
        for b in (i, j):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = f
                return True
        b, undo = j, []
        for step in range(self.KICKS):
            s = (f + step) % self.SLOTS
            undo.append((b, s, int(self.table[b, s])))
            f, self.table[b, s] = int(self.table[b, s]), f
            b ^= (self._mix(f) >> 40) & (self.buckets - 1)
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = f
                return True
        for b, s, old in reversed(undo):
            self.table[b, s] = old
        return False

    def delete(self, k1: int, k2: int) -> bool:
        """Only for keys that were inserted."""
        f, i, j = self._place(k1, k2)
        for b in (i, j):
            at = np.flatnonzero(self.table[b] == f)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        u1, u2 = k1.astype(np.uint64), k2.astype(np.uint64)
        f = u2 & np.uint64(0xFFFF)
        f = np.where(f == 0, np.uint64(1), f)
        mask = np.uint64(self.buckets - 1)
        i = (u1 >> np.uint64(8)) & mask
        j = i ^ ((self._mix(f) >> np.uint64(40)) & mask)
        want = f.astype(np.uint16)[:, None]
        return (self.table[i.astype(np.int64)] == want).any(1) | (self.table[j.astype(np.int64)] == want).any(1)

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        capacity = max(16, len(k1))
        while True:
            got = cls(capacity)
            if all(got.insert(int(a) & (2**64 - 1), int(b) & (2**64 - 1)) for a, b in zip(k1, k2, strict=True)):
                return got
            capacity *= 2


def build_filters(active: DataFrame) -> DataFrame:
    """(shard, n, blob): one filter per shard, of about KEYS_PER_SHARD keys, so a group has a bounded size."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        got = CuckooFilter.build(pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(pdf)], "blob": [got.dump()]})

    return active.select("shard", "k1", "k2").groupBy("shard").applyInPandas(build, "shard int, n long, blob binary")


def update_filters(filters: DataFrame, changes: DataFrame, active: DataFrame) -> DataFrame:
    """filters after changes (shard, k1, k2, add boolean): deletions first; a shard whose filter gets full is built anew from `active`."""
    both = (
        changes.select("shard", "k1", "k2", F.when(F.col("add"), 1).otherwise(-1).alias("what"), F.lit(None).cast("binary").alias("blob"))
        .unionByName(active.select("shard", "k1", "k2", F.lit(0).alias("what"), F.lit(None).cast("binary").alias("blob")))
        .unionByName(filters.select("shard", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(2).alias("what"), "blob"))
    )

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        old, live = pdf[pdf["what"] == 2], pdf[pdf["what"] == 0]
        kept = CuckooFilter.load(old["blob"].iloc[0]) if len(old) else None
        ok = kept is not None
        for what, op in ((-1, "delete"), (1, "insert")):
            part = pdf[pdf["what"] == what]
            ok = ok and all(getattr(kept, op)(int(a) & (2**64 - 1), int(b) & (2**64 - 1)) for a, b in zip(part["k1"], part["k2"], strict=True))
        if not ok:
            kept = CuckooFilter.build(live["k1"].to_numpy(), live["k2"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(live)], "blob": [kept.dump()]})

    return both.groupBy("shard").applyInPandas(step, "shard int, n long, blob binary")


# -- reference counts --------------------------------------------------------------------------------------------------
def document_keys(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(k1, k2, doc_id): the distinct keys of at least MIN_CHARS code points of each row; nothing is shuffled."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= MIN_CHARS))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.explode(keys).alias("key"))
    k1, k2 = key_hashes(F.col("key"))
    return slim.select(k1.alias("k1"), k2.alias("k2"), "doc_id")


def reference_counts(keys: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n): rows of a document that hold a key. Dealt by key and document, so a line of very many documents is no hot group."""
    return keys.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def activate(refs: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """Active keys of reference counts: those of at least min_docs documents, with the largest doc_id. Sums are made before the shuffle."""
    found = refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    return found.withColumn("shard", F.pmod(F.col("k1"), F.lit(shards)).cast("int"))


def shards_for(n_keys: int) -> int:
    return max(1, -(-n_keys // KEYS_PER_SHARD))


# -- applying ----------------------------------------------------------------------------------------------------------
_APPLIED = "n_lines long, n_dropped long, kept string"


def apply_active(docs: DataFrame, active: DataFrame, filters: DataFrame, *, text: str, doc_id: str, shards: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `extra`, n_lines, n_dropped, kept (the lines that stay, joined by newlines).

    At every size a line first meets the cuckoo filter of its key's shard, and only what the filter holds meets the exact
    keys. The measured size of filters and keys says how: sent to the tasks, or brought together with the lines by shard.
    """
    names = {c.lower() for c in ("doc_id", "n_lines", "n_dropped", "kept")}
    if clash := [c for c in extra if c.lower() in names]:
        raise ValueError(f"names of the result can't be extra columns: {clash}")
    size = filters.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0] + active.agg(F.coalesce(F.sum(32 + F.length(F.coalesce(F.col("keeper").cast("string"), F.lit("")))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return _apply_here(docs, active, filters, text, doc_id, shards, extra)
    return _apply_sharded(docs, active, filters, text, doc_id, shards, extra)


def _apply_here(docs, active, filters, text, doc_id, shards, extra) -> DataFrame:
    """The tables are small (measured): every task gets the filters and the exact keys as sorted arrays; no text is shuffled."""
    sc = docs.sparkSession.sparkContext
    exact = active.select("k1", "k2", F.col("keeper").cast("string").alias("keeper")).toPandas().sort_values(["k1", "k2"])
    blobs = {r.shard: bytes(r.blob) for r in filters.collect()}
    state = sc.broadcast((exact["k1"].to_numpy(np.int64), exact["k2"].to_numpy(np.int64), pa.array(exact["keeper"], pa.string()), blobs))
    slim = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(doc_id).cast("string").alias("__as_text"), *extra)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1s, k2s, keepers, raw = state.value
        cuckoo = {s: CuckooFilter.load(b) for s, b in raw.items()}
        for batch in batches:
            ids, texts = batch.column(2).to_pylist(), batch.column(1)
            split = [(x.as_buffer().to_pybytes() if x.is_valid else b"").split(b"\n") for x in texts]
            # hashes of all lines of the batch that are long enough, then the filters, shard by shard
            names, where = {}, []
            for d, lines in enumerate(split):
                for p, line in enumerate(lines):
                    if len(line) >= MIN_CHARS:
                        key = normalise(line)
                        if len(key) >= MIN_CHARS and n_code_points(key) >= MIN_CHARS:
                            where.append((d, p, names.setdefault(key, len(names))))
            dropped: dict[int, set[int]] = {}
            if names and cuckoo:
                pairs = np.array([python_keys(k) for k in names], np.int64)
                shard, maybe = np.mod(pairs[:, 0], shards), np.zeros(len(pairs), bool)
                for s in np.unique(shard):
                    if int(s) in cuckoo:
                        at = np.flatnonzero(shard == s)
                        maybe[at] = cuckoo[int(s)].holds(pairs[at, 0].view(np.uint64), pairs[at, 1].view(np.uint64))
                keeper = {int(i): keepers[row].as_py() for i in np.flatnonzero(maybe) if (row := _find(k1s, k2s, pairs[i, 0], pairs[i, 1])) >= 0}
                for d, p, k in where:
                    if k in keeper and keeper[k] != ids[d]:
                        dropped.setdefault(d, set()).add(p)
            kept = [b"\n".join(x for p, x in enumerate(lines) if p not in dropped[d]) if d in dropped else b"\n".join(lines) for d, lines in enumerate(split)]
            arrays = [batch.column(0), *(batch.column(3 + i) for i in range(len(extra)))]
            arrays += [pa.array(map(len, split), pa.int64()), pa.array([len(dropped.get(d, ())) for d in range(len(split))], pa.int64())]
            arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *extra, "n_lines", "n_dropped", "kept"])

    kinds = dict(slim.dtypes)
    head = ", ".join([f"doc_id {kinds['__id']}", *(f"`{c}` {kinds[c]}" for c in extra)])
    return slim.mapInArrow(probe, f"{head}, {_APPLIED}")


def _find(k1s: np.ndarray, k2s: np.ndarray, a, b) -> int:
    """Row of a key in arrays sorted by (k1, k2), or -1."""
    lo, hi = np.searchsorted(k1s, a), np.searchsorted(k1s, a, "right")
    at = lo + int(np.searchsorted(k2s[lo:hi], b))
    return at if at < hi and k2s[at] == b else -1


def _apply_sharded(docs, active, filters, text, doc_id, shards, extra) -> DataFrame:
    """The tables are large: lines are dealt by shard and salt, pass the shard's filter as a stream behind it, and the rest meets the exact keys; decisions come back by a row key."""
    rows = docs.select(F.expr("uuid()").alias("__row"), F.col(doc_id).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("__lines"), *extra)
    rows = materialise(rows, "lines")  # the row key must not change if a task runs again
    line = rows.select("__row", "doc_id", F.posexplode("__lines").alias("pos", "line")).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= MIN_CHARS)
    k1, k2 = key_hashes(F.col("key"))
    maybe = probe_shards(line.select("__row", "pos", k1.alias("k1"), k2.alias("k2")), filters, shards)
    keys = active.select(F.struct("k1", "k2").alias("key"), "keeper")
    weight = active.select(F.struct("k1", "k2").alias("key"), F.col("n_docs").alias("n"))
    hits = spread_join(maybe.select("__row", "pos", F.struct("k1", "k2").alias("key")), keys, "key", hot_keys(weight, "key"), "__row")
    hits = hits.join(rows.select("__row", "doc_id"), "__row").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = hits.groupBy("__row").agg(F.array_sort(F.collect_set("pos")).alias("__drop"))
    both = rows.join(drops, "__row", "left").withColumn("__drop", F.coalesce("__drop", F.array().cast("array<int>")))
    gone = F.map_from_arrays("__drop", F.transform("__drop", lambda _: F.lit(True)))
    kept = F.when(F.size("__drop") == 0, F.col("__lines")).otherwise(F.filter("__lines", lambda x, i: F.try_element_at(gone, i).isNull()))
    return both.select("doc_id", *extra, F.size("__lines").cast("long").alias("n_lines"), F.size("__drop").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def probe_shards(lines: DataFrame, filters: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """Rows of lines (__row, pos, k1, k2) whose key the filter of its shard (pmod(k1, shards)) may hold.

    A shard's lines are dealt over `salts` tasks by their document, so a hot line is no hot group; each of them gets the shard's
    filter first and then streams the lines past it. A task holds one filter.
    """
    none = F.lit(None)
    asked = lines.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), none.cast("binary").alias("blob"), "__row", "pos", "k1", "k2")
    sent = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "blob", none.cast("string").alias("__row"), none.cast("int").alias("pos"), none.cast("long").alias("k1"), none.cast("long").alias("k2"))
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = asked.unionByName(sent).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cuckoo = None, None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            stops = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True] | np.r_[True, kind[1:] != kind[:-1], True]) if len(shard) else []
            for a, b in zip(stops[:-1], stops[1:], strict=True):
                if kind[a] == 0:
                    at, cuckoo = int(shard[a]), CuckooFilter.load(batch.column(3)[a].as_py())
                elif at == int(shard[a]):
                    part = batch.slice(a, b - a).select([4, 5, 6, 7])
                    held = cuckoo.holds(part.column(2).to_numpy().view(np.uint64), part.column(3).to_numpy().view(np.uint64))
                    if held.any():
                        yield part.filter(pa.array(held))

    return dealt.mapInArrow(run, "__row string, pos int, k1 long, k2 long")


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Drop repeated lines of one corpus: doc_id, `extra`, n_lines, n_dropped, kept; one row per row of docs.

    Keys of at least 20 code points found in at least min_docs documents lose all their lines except in the largest doc_id
    holding it. Null or empty text: one empty line. Rows of one doc_id are one document, as are all rows without a doc_id,
    which is smaller than any other; all rows of the largest doc_id keep the line. A text of any length is split as a whole.
    An empty table gives an empty result; columns beside those named are not read, and `extra` may not name a column of the
    result.
    """
    active = materialise(activate(reference_counts(document_keys(docs, text, doc_id)), 1, min_docs).drop("shard"), "active")
    shards = shards_for(active.count())
    active = active.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
    filters = materialise(build_filters(active), "filters")
    return apply_active(docs, active, filters, text=text, doc_id=doc_id, shards=shards, extra=extra)


class LineIndex:
    """An incremental index in a shared folder: documents can be inserted and deleted.

    A change writes its reference counts, reads those of the shards that it touches, and writes new active keys and filters of
    these shards only. `state/v=N`, written last, names for every shard the version that holds it, so a change that fails leaves
    nothing that counts. An index opened on a folder that holds one goes on from its last finished change, with the shards and min_docs it was made
    with. When the active keys get too many for the shards, all is dealt to more of them, so that a shard's filter, which one task makes, keeps its size. One
    writer at a time. Rows of one doc_id add up, null ids being one document; texts are read as in dedup_lines, whatever their length; an empty table
    changes nothing; columns beside text and doc_id are not read by changes. A deletion of what was not inserted is refused as a whole.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 64, min_docs: int = MIN_DOCS):
        self.spark, self.shards, self.min_docs = spark, shards, min_docs
        self.path = path or f"{scratch_dir(spark)}/line-index-{uuid.uuid4().hex}"
        self.version, self.refs, self.holds = 0, [], {}  # holds: shard -> version of its active keys and filter
        done = finished_versions(spark, f"{self.path}/state")
        if done:
            last = spark.read.parquet(f"{self.path}/state/v={done[-1]}").first()
            self.version, self.refs, self.shards, self.min_docs = last.version, list(last.refs), last.shards, last.min_docs
            self.holds = {h.shard: h.version for h in last.holds}

    def _publish(self, version: int, refs: list[int], holds: dict[int, int], shards: int) -> None:
        """The state, written last; from here on it counts."""
        row = (version, refs, sorted(holds.items()), shards, self.min_docs)
        self.spark.createDataFrame([row], "version int, refs array<int>, holds array<struct<shard:int,version:int>>, shards int, min_docs int").write.mode("overwrite").parquet(f"{self.path}/state/v={version}")
        self.version, self.refs, self.holds, self.shards = version, refs, holds, shards

    def _regrow(self) -> None:
        """More shards, once they hold twice the keys meant for them: reference counts are summed up, and keys and filters written, by new shards."""
        n = self._read("active", range(self.shards)).count()
        if n <= 2 * KEYS_PER_SHARD * self.shards:
            return
        to, shards = self.version + 1, 2 * shards_for(n)
        every = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/refs/v={v}") for v in self.refs))
        live = every.groupBy("k1", "k2", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0")
        live.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/refs/v={to}")
        active = self._read("active", range(self.shards)).withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
        active.write.mode("overwrite").parquet(f"{self.path}/active/v={to}")
        build_filters(self.spark.read.parquet(f"{self.path}/active/v={to}")).write.mode("overwrite").parquet(f"{self.path}/filters/v={to}")
        self._publish(to, [to], dict.fromkeys(range(shards), to), shards)

    def _read(self, name: str, shards) -> DataFrame | None:
        """The present rows of `shards`; None if no version holds any of them."""
        by: dict[int, list[int]] = {}
        for s in shards:
            if s in self.holds:
                by.setdefault(self.holds[s], []).append(s)
        found = [self.spark.read.parquet(f"{self.path}/{name}/v={v}").filter(F.col("shard").isin(own)) for v, own in by.items()]
        return reduce(DataFrame.unionByName, found) if found else None

    def _change(self, docs: DataFrame, sign: int, text: str, doc_id: str) -> None:
        to = self.version + 1
        refs = reference_counts(document_keys(docs, text, doc_id)).withColumn("n", F.col("n") * sign).withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int"))
        refs.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/refs/v={to}")
        try:
            touched = [r.shard for r in self.spark.read.parquet(f"{self.path}/refs/v={to}").select("shard").distinct().collect()]
        except AnalysisException:  # no row, no file
            return
        every = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/refs/v={v}") for v in [*self.refs, to])).filter(F.col("shard").isin(touched))
        summed = every.groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("n").alias("n"))
        if sign < 0 and summed.filter("n < 0").head(1):
            raise ValueError("documents that were not inserted can't be deleted")
        live = summed.filter("n > 0")
        new = live.groupBy("shard", "k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= self.min_docs)
        new.write.mode("overwrite").parquet(f"{self.path}/active/v={to}")
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/active/v={to}")
        old, kept = self._read("active", touched), self._read("filters", touched)
        old = new.limit(0) if old is None else old
        kept = self.spark.createDataFrame([], "shard int, n long, blob binary") if kept is None else kept
        came = new.join(old, ["shard", "k1", "k2"], "left_anti").select("shard", "k1", "k2", F.lit(True).alias("add"))
        went = old.join(new, ["shard", "k1", "k2"], "left_anti").select("shard", "k1", "k2", F.lit(False).alias("add"))
        update_filters(kept, came.unionByName(went), new).write.mode("overwrite").parquet(f"{self.path}/filters/v={to}")
        self._publish(to, [*self.refs, to], self.holds | dict.fromkeys(touched, to), self.shards)
        self._regrow()

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        self._change(docs, 1, text, doc_id)

    def delete(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        """docs as they were inserted; their references go, and lines that others hold come back where they are too few now."""
        self._change(docs, -1, text, doc_id)

    def apply(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
        active, filters = self._read("active", range(self.shards)), self._read("filters", range(self.shards))
        if active is None:
            active, filters = self.spark.createDataFrame([], "shard int, k1 long, k2 long, n_docs long, keeper string"), self.spark.createDataFrame([], "shard int, n long, blob binary")
        return apply_active(docs, active, filters, text=text, doc_id=doc_id, shards=self.shards, extra=extra)
