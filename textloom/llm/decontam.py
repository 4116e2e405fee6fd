"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each row is a block of documents with its terms, and for every term the sorted
positions of its occurrences in the block (postings). A search sends the phrases, not the postings. They are kept under the
term that the fewest phrases hold; a block looks up its own terms there, so it meets only the phrases whose rarest term it has.
The positions of a phrase's terms, rarest in the block first, are shifted by the term's offset and intersected, so an absent
or rare term ends the work at once. No posting is shuffled, and a lost executor costs the blocks it held.

Phrases are a table; they are sent in groups of GROUP_WORDS words (counted), one search of the index each, and a document's
hits are summed up over the groups, so neither the driver nor a task holds more of a large benchmark than one group.

Storing postings for the phrases' terms only (`terms`) is exact, as no other term can take part in a match.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise, release

WINDOW = 13
BLOCK_TOKENS = 1 << 20  # a block ends after the document that reaches it
GROUP_WORDS = 1 << 20  # words of the phrases sent at once, some 100 MB as Python objects
MOST_TERMS = 1 << 20  # terms of the phrases that are sent to choose the postings; with more, all postings are stored
INDEX = "block string, doc_ids array<{}>, n_words array<int>, starts array<long>, terms array<string>, ends array<long>, positions binary"


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


#: Lower-cases A-Z and turns every separator into a space.
_TO_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))


def build_index(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", terms: list[bytes] | None = None, gap: int = 64, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of postings (see INDEX). gap: free positions between documents, more than any phrase's length, so that no match spans two.

    terms: store postings of these only. Null texts and texts without words are in doc_ids with n_words 0. Positions are
    int64 within the block, so the length of a text is not limited by the block's size; they are stored packed (see pack). A
    block's name is new at each run: write the index before it is searched more than once.
    """
    known = None if terms is None else docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(sorted(terms))})
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = known.value if known is not None else None
        state = _Block(fixed, gap)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state.add(i, t.as_buffer().to_pybytes() if t.is_valid else b"")
                if state.n_tokens >= block_tokens or len(state.doc_ids) >= block_tokens // 16:
                    yield state.row(batch.column(0).type)
                    state = _Block(fixed, gap)
            kind = batch.column(0).type
        if state.doc_ids:
            yield state.row(kind)
        del state
        release()

    return slim.mapInArrow(index, INDEX.format(dict(slim.dtypes)["doc_id"]))


def pack(positions: np.ndarray) -> bytes:
    """int64 positions as the compressed steps from one to the next: a block stands in several buffers of the JVM and of Arrow at once, when it is written and when it is read."""
    return pa.compress(np.diff(positions, prepend=0).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    """The n positions that pack was given."""
    steps = pa.decompress(packed, decompressed_size=8 * n, codec="zstd") if n else b""
    return np.cumsum(np.frombuffer(steps, np.int64))


class _Block:
    def __init__(self, fixed: dict[bytes, int] | None, gap: int):
        self.fixed, self.gap = fixed, gap
        self.ids = {} if fixed is None else fixed
        self.doc_ids, self.n_words, self.starts, self.term_ids, self.places = [], [], [], [], []
        self.next = self.n_tokens = 0

    def add(self, doc_id, raw: bytes) -> None:
        words = raw.translate(_TO_WORDS).split()
        n = len(words)
        self.doc_ids.append(doc_id)
        self.n_words.append(n)
        self.starts.append(self.next)
        if n:
            if self.fixed is None:
                got = np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in words), np.int32, n)
            else:
                got = np.fromiter(map(self.ids.get, words, _ABSENT), np.int32, n)
            at = np.flatnonzero(got >= 0)
            self.term_ids.append(got[at])
            self.places.append(at + self.next)
        self.next += n + self.gap
        self.n_tokens += n + self.gap

    def row(self, id_kind: pa.DataType) -> pa.RecordBatch:
        terms = np.concatenate(self.term_ids) if self.term_ids else np.zeros(0, np.int32)
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        used, counts = np.unique(terms, return_counts=True)
        names = sorted(self.ids, key=self.ids.get) if self.fixed is None else list(self.ids)
        cols = [self.doc_ids, self.n_words, self.starts, [names[i].decode("utf-8", "surrogatepass") for i in used], np.cumsum(counts).tolist()]
        kinds = [id_kind, pa.int32(), pa.int64(), pa.string(), pa.int64()]
        arrays = [pa.array([uuid.uuid4().hex]), *(pa.array([c], pa.list_(k)) for c, k in zip(cols, kinds, strict=True))]
        arrays.append(pa.array([pack(places[order].astype(np.int64))], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=["block", "doc_ids", "n_words", "starts", "terms", "ends", "positions"])


class _Absent:
    """An endless run of -1, the default of dict.get for a word without postings."""

    def __iter__(self):
        return self

    def __next__(self):
        return -1


_ABSENT = _Absent()


class Postings:
    """One block of the index in memory."""

    def __init__(self, terms: list[str], ends, positions: bytes):
        self.at = {t: i for i, t in enumerate(terms)}
        self.bounds = np.concatenate([[0], np.asarray(ends, np.int64)])
        self.positions = unpack(positions, int(self.bounds[-1]))

    def count(self, term: str) -> int:
        i = self.at.get(term)
        return 0 if i is None else int(self.bounds[i + 1] - self.bounds[i])

    def of(self, term: str) -> np.ndarray:
        i = self.at[term]
        return self.positions[self.bounds[i] : self.bounds[i + 1]]

    def phrase(self, words: tuple[str, ...]) -> np.ndarray:
        """Start positions of the exact phrase: lists shifted by their offsets, intersected from the rarest term."""
        counts = [self.count(w) for w in words]
        if not words or min(counts) == 0:
            return np.zeros(0, np.int64)
        order = sorted(range(len(words)), key=counts.__getitem__)
        starts = self.of(words[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.of(words[k])
            at = np.searchsorted(other, starts + k)
            starts = starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == starts + k)]
        return starts

    def near(self, words: tuple[str, ...], slop: int) -> np.ndarray:
        """Positions of the rarest term around which all other terms occur within slop words, in any order."""
        counts = [self.count(w) for w in words]
        if not words or min(counts) == 0:
            return np.zeros(0, np.int64)
        order = sorted(set(words), key=lambda w: counts[words.index(w)])
        at = self.of(order[0])
        for w in order[1:]:
            other = self.of(w)
            i = np.searchsorted(other, at)
            left = np.where(i > 0, at - other[np.maximum(i - 1, 0)], slop + 1)
            right = np.where(i < len(other), other[np.minimum(i, len(other) - 1)] - at, slop + 1)
            at = at[np.minimum(left, right) <= slop]
        return at


def windows(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """All runs of `size` words; a text of fewer, but not none, is one run."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def phrase_table(items: DataFrame, *, text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """(phrase, items): distinct windows of the items, words joined by a space, with the ids (as sorted text) of their items.

    Null ids hold no item of their own: their windows are searched and mark words, but name no item.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                found = [b" ".join(w) for w in windows((t.as_buffer().to_pybytes() if t.is_valid else b"").translate(_TO_WORDS).split(), size)]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string())], names=["item", "phrase"])

    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).mapInArrow(cut, "item string, phrase string")
    return rows.groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


def by_rarest(phrases: dict[tuple[str, ...], list]) -> dict[str, list]:
    """Phrases and their items under the term that the fewest phrases hold, first in order of equals."""
    held = Counter(w for p in phrases for w in set(p))
    found: dict[str, list] = {}
    for p, items in sorted(phrases.items()):
        found.setdefault(min(p, key=lambda w: (held[w], w)), []).append((p, items))
    return found


def search(index: DataFrame, phrases: dict[tuple[str, ...], list]) -> DataFrame:
    """Per document of the index: doc_id, n_words, n_hit (words inside any occurrence of a phrase), items (ids, sorted as text). The phrases are one group."""
    sent = index.sparkSession.sparkContext.broadcast(by_rarest(phrases))
    id_kind = _id_kind(index)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(_rows(batch)):
                spans, found = _spans(row, sent.value)
                n_hit = [sum(e - s for s, e in spans.get(d, ())) for d in range(len(row["n_words"]))]
                cols = [batch.column("doc_ids")[i].values, pa.array(row["n_words"], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(found.get(d, ())) for d in range(len(n_hit))], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "items"])

    return index.mapInArrow(look, f"doc_id {id_kind}, n_words long, n_hit long, items array<string>")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch, one in memory at a time."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()


def _id_kind(index: DataFrame) -> str:
    return dict(index.dtypes)["doc_ids"][len("array<") : -1]


def _spans(row: dict, phrases: dict[str, list]) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set]]:
    """Of a block: by document, the merged spans (in words) of all occurrences, and the items. Only phrases under a term of the block are visited."""
    block, starts = Postings(row["terms"], row["ends"], row["positions"]), np.asarray(row["starts"], np.int64)
    first, last, found = [], [], {}
    for term in row["terms"] if len(row["terms"]) < len(phrases) else [x for x in phrases if x in block.at]:
        for words, items in phrases.get(term, ()):
            at = block.phrase(words)
            if len(at):
                first.append(at)
                last.append(at + len(words))
                for d in np.unique(np.searchsorted(starts, at, "right") - 1):
                    found.setdefault(int(d), set()).update(items)
    spans: dict[int, list[tuple[int, int]]] = {}
    if first:
        a, b = np.concatenate(first), np.concatenate(last)
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
        begin, end = a[new], b[np.r_[new[1:] - 1, len(b) - 1]]
        doc = np.searchsorted(starts, begin, "right") - 1  # the gap between documents keeps spans apart
        for d, s, e in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist(), strict=True):
            spans.setdefault(d, []).append((s, e))
    return spans, found


def search_groups(index: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """As search, for a table (phrase, items) searched in `groups` parts by the phrase's hash; index and table are written ones."""
    spark, parts = index.sparkSession, []
    schema = "block string, doc int, spans array<struct<s:int,e:int>>, items array<string>"
    for g in range(groups):
        sent = spark.sparkContext.broadcast(by_rarest(_phrases(table.filter(F.pmod(F.xxhash64("phrase"), F.lit(groups)) == g))))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _rows(batch):
                    spans, found = _spans(row, sent.value)
                    cols = [pa.array([row["block"]] * len(spans), pa.string()), pa.array(list(spans), pa.int32())]
                    cols.append(pa.array([[{"s": s, "e": e} for s, e in x] for x in spans.values()], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))))
                    cols.append(pa.array([sorted(found[d]) for d in spans], pa.list_(pa.string())))
                    yield pa.RecordBatch.from_arrays(cols, names=["block", "doc", "spans", "items"])

        parts.append(materialise(index.select("block", "doc_ids", "n_words", "starts", "terms", "ends", "positions").mapInArrow(look, schema), "hits"))
        sent.unpersist()
    every = reduce(DataFrame.unionByName, parts)
    merged = every.groupBy("block", "doc").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a.end, x.e).alias("end"), (a.n + F.greatest(F.lit(0), x.e - F.greatest(a.end, x.s))).cast("long").alias("n"))
    merged = merged.select("block", "doc", F.aggregate("spans", zero, step, lambda a: a.n).alias("n_hit"), "items")
    docs = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc", "x")).select("block", "doc", "x.doc_ids", "x.n_words")
    got = docs.join(merged, ["block", "doc"], "left")
    return got.select(F.col("doc_ids").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _phrases(table: DataFrame) -> dict[tuple[str, ...], list]:
    return {tuple(r.phrase.split(" ")): r["items"] for r in table.collect()}


def proximity(index: DataFrame, queries: dict[str, tuple[str, ...]], slop: int) -> DataFrame:
    """(doc_id, query, position): where all words of a query occur within slop words around its rarest term, position in words of the document."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(_rows(batch)):
                block, starts = Postings(row["terms"], row["ends"], row["positions"]), np.asarray(row["starts"], np.int64)
                for name, words in sent.value.items():
                    at = block.near(tuple(words), slop)
                    d = np.searchsorted(starts, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values.take(pa.array(d, pa.int64())), pa.array([name] * len(at), pa.string()), pa.array(at - starts[d] if len(at) else at, pa.int64())], names=["doc_id", "query", "position"])

    return index.mapInArrow(look, f"doc_id {_id_kind(index)}, query string, position long")


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated (n_hit > 0 and 20 * n_hit >= n_words); one row per row of docs.

    Null texts have no words and are clean; a text of any length is read as a whole. Repeated items count once, repeated rows
    of docs are judged alike; doc_id may have any type and be null. An empty benchmark leaves all documents clean; an empty
    table gives an empty result. Columns beside those named are not read, whatever their names.
    """
    table = materialise(phrase_table(items, text=item_text, item_id=item_id, size=size), "phrases")
    words = F.split("phrase", " ")
    n_words = table.agg(F.coalesce(F.sum(F.size(words)), F.lit(0))).first()[0]
    vocabulary = [r.w for r in table.select(F.explode(words).alias("w")).distinct().limit(MOST_TERMS + 1).collect()]
    terms = [w.encode("utf-8", "surrogatepass") for w in vocabulary] if len(vocabulary) <= MOST_TERMS else None
    index = materialise(build_index(docs, text=text, doc_id=doc_id, terms=terms, gap=size), "index")
    groups = max(1, -(-n_words // GROUP_WORDS))
    found = search(index, _phrases(table)) if groups == 1 else search_groups(index, table, groups)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
