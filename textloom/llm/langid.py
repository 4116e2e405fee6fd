"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from its code point and a seed. An n-gram is bound by permuting (rolling)
each letter's vector by its place and multiplying; a text is the bundle (sum) of its n-grams, weighted by the square root of
their counts, and a language is the bundle of its training texts. A text gets the language of the closest prototype by
cosine, both taken relative to the mean of all prototypes, which holds what the languages share.

Prototypes are learned from a bounded sample of labelled rows (FIT_ROWS, by a seeded hash over all of them), as sums that
Spark adds up; prediction covers every whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name

DIM, SEED, N = 1024, 17, 3
FIT_ROWS = 12_000
CHUNK_CHARS, GROUP_TEXTS = 1 << 20, 48
UNKNOWN = "und"


class Letters:
    """Symbols of code points: 0 for what is no letter (a word's edge), else 1, 2, ... by first appearance; and their vectors."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.symbol = np.full(0x110000, -1, np.int32)
        self.vectors, self.used = np.zeros((256, dim), np.int8), 0  # one byte a component: all of Unicode's letters take some 140 MB
        self._add(0)

    def _add(self, code: int) -> None:
        if self.used == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[self.used] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        self.used += 1

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        got = self.symbol[codes]
        if (got < 0).any():
            for c in np.unique(codes[got < 0]):
                if unicodedata.category(chr(c)).startswith("L"):
                    self.symbol[c] = self.used
                    self._add(int(c))
                else:
                    self.symbol[c] = 0
            got = self.symbol[codes]
        return got

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given as packed symbols: the product of the letters' vectors, each rolled by its place."""
        out = np.ones((len(grams), self.dim), np.float32)
        for k in range(N):
            symbols, back = np.unique((grams >> (21 * k)) & 0x1FFFFF, return_inverse=True)
            out *= np.roll(self.vectors[symbols], k, axis=1)[back]
        return out


def grams_of(letters: Letters, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, packed, and their counts; runs that hold no letter, or an edge in the middle, don't count."""
    keys, counts = [], []
    text = text or ""
    for at in range(0, len(text), CHUNK_CHARS):  # in pieces that overlap, so that memory is bounded for any text
        s = letters.encode(text[max(0, at - (N - 1)) : at + CHUNK_CHARS]).astype(np.int64)
        if at == 0:
            s = np.concatenate([[0], s])
        if at + CHUNK_CHARS >= len(text):
            s = np.append(s, 0)
        if len(s) >= N:
            a, b, c = s[:-2], s[1:-1], s[2:]
            key = (a | b << 21 | c << 42)[b > 0]
            k, n = np.unique(key, return_counts=True)
            keys.append(k)
            counts.append(n)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def bundle(letters: Letters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and whether a text has a letter. Texts are bundled in groups by one matrix product."""
    out, has = np.zeros((len(texts), letters.dim), np.float32), np.zeros(len(texts), bool)
    for at in range(0, len(texts), GROUP_TEXTS):
        own = [grams_of(letters, t) for t in texts[at : at + GROUP_TEXTS]]
        grams, back = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
        weights = np.zeros((len(own), len(grams)), np.float32)
        row = np.repeat(np.arange(len(own)), [len(k) for k, _ in own])
        weights[row, back] = np.sqrt(np.concatenate([n for _, n in own]))
        for lo in range(0, len(grams), 8192):
            out[at : at + len(own)] += weights[:, lo : lo + 8192] @ letters.bind(grams[lo : lo + 8192])
        has[at : at + len(own)] = [len(k) > 0 for k, _ in own]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), has


@dataclass
class Profiles:
    langs: list[str]
    mean: np.ndarray
    prototypes: np.ndarray  # unit rows, relative to the mean

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the closest language and its cosine, mapped to 0..1."""
        if len(self.langs) == 1:
            base = self.prototypes if np.any(self.prototypes) else self.mean[None]
            cos = vectors @ (base[0] / max(1e-9, np.linalg.norm(base[0])))
            return np.zeros(len(vectors), np.int64), np.clip((1 + cos) / 2, 0, 1)
        rest = vectors - self.mean
        rest /= np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9)
        cos = rest @ self.prototypes.T
        best = cos.argmax(1)
        return best, np.clip((1 + cos[np.arange(len(cos)), best]) / 2, 0, 1)


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train=None, rows: int = FIT_ROWS) -> Profiles | None:
    """Prototypes from about `rows` rows (train: a condition) with a language and a text; None if there are none."""
    slim = docs.filter(train) if train is not None else docs
    slim = slim.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    total = slim.count()
    if not total:
        return None
    # languages are sampled to the same number of rows each, so that a rare one is learned too
    per = {r.lang: r["count"] for r in slim.groupBy("lang").count().collect()}
    goal = max(1, rows // len(per))
    share = F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, goal / n)))])
    draw = F.pmod(F.xxhash64(F.lit(31), F.col("doc_id").cast("string"), F.length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = slim.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, total = Letters(), {}
        for pdf in batches:
            vectors, has = bundle(letters, pdf["text"].tolist())
            for name in pdf["lang"].unique():
                at = ((pdf["lang"] == name) & has).to_numpy()
                if at.any():
                    total[name] = total.get(name, 0) + np.append(vectors[at].sum(0, dtype=np.float64), at.sum())
        for name, v in total.items():
            yield pd.DataFrame({"lang": name, "i": np.arange(DIM + 1, dtype=np.int32), "v": v})

    got = picked.mapInPandas(sums, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        return None
    grid = got.pivot(index="lang", columns="i", values="v").loc[langs].to_numpy()
    proto = grid[:, :DIM] / grid[:, DIM:]
    proto = np.round(proto / np.linalg.norm(proto, axis=1, keepdims=True), 6)  # the order of additions plays no part
    mean = proto.mean(0) if len(langs) > 1 else proto[0]
    rest = proto - mean
    norm = np.linalg.norm(rest, axis=1, keepdims=True)
    return Profiles(langs, mean.astype(np.float32), (rest / np.where(norm > 0, norm, 1)).astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred and score of every row; `und` with score 0 for a null text, one without a letter, or without profiles. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    slim = docs.select(*keep, F.col(text).alias(free_name(keep, "__text")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = Letters(), sent.value
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if known is not None and batch.num_rows:
                vectors, has = bundle(letters, batch.column(len(keep)).to_pylist())
                best, close = known.predict(vectors)
                names = [known.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                scores = np.where(has, close, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(judge, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"]))


def identify(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train=None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the rows that meet `train`, predict all: `keep`, lang_pred, score.

    Texts of any length are read as a whole, in pieces of bounded size. Repeated rows are predicted alike; of languages equally
    close the first by name is taken. Null texts and texts without letters are `und`; a null lang plays no part in learning, and
    without any language all rows are `und`. An empty table gives an empty result; other columns are not read, and `keep` may
    not hold names of the result.
    """
    if clash := [c for c in keep if c.lower() in ("lang_pred", "score")]:
        raise ValueError(f"names of the result can't be kept columns: {clash}")
    return predict(docs, learn(docs, text=text, lang=lang, doc_id=doc_id, train=train), text=text, keep=keep)
