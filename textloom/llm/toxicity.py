"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed features is trained with numpy from confirmed toxic documents and unlabelled text, on the
class-prior-corrected non-negative risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-)).  Features are present or absent: words and
word beginnings, so that unseen inflections of a known word count too. A document is scored by the evidence of its
features; a calibration on the training labels turns that into a probability.

The fit reads a bounded sample (POSITIVES, UNLABELLED, CALIBRATION rows, drawn by a seeded hash over all documents);
scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name, release

BITS = 20
POSITIVES, UNLABELLED, CALIBRATION = 2000, 5000, 3000
#: Bytes of text that each of the three samples holds (expected); a text's features take no more bytes than some five times its own.
FIT_BYTES = 32 << 20
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
_SPLIT = {c: " " for c in range(0x80) if not chr(c).isalnum()}


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().translate(_SPLIT).split())


def features(word: str) -> list[int]:
    """The word itself and its beginnings, hashed."""
    names = [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh64_intdigest(n, 3) >> (64 - BITS) for n in names]


class Encoder:
    """Feature ids of texts; words are remembered up to a bound, so memory doesn't grow with the input."""

    LIMIT = 1 << 17

    def __init__(self):
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.memo) > self.LIMIT:
            self.memo.clear()
        memo, found = self.memo, set()
        for w in words_of(text):
            got = memo.get(w)
            if got is None:
                got = memo[w] = tuple(features(w))
            found.update(got)
        return np.fromiter(found, np.int64, len(found))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        raw = np.array([self.weights[r].sum() + self.bias for r in rows])
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return np.concatenate(rows) if rows else np.zeros(0, np.int32), at


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, steps: int = 400, rate: float = 0.05, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative PU risk with the logistic loss, over the whole sample in each step.

    If the estimated negative risk falls below zero, the step goes against it (the max(0, .) of the estimator), which keeps
    the model from fitting the unlabelled positives as negatives. Weights stay at 0 or above: a feature's presence is
    evidence for toxicity, and common features carry none.
    """
    n = 1 << BITS
    start = _start(positive, unlabelled, n)
    live = np.flatnonzero(start)
    dense = np.full(n, -1, np.int32)
    dense[live] = np.arange(len(live))
    # only the few live features of each text are kept, text by text, so no array of all features is made
    own = lambda rows: [x[x >= 0] for x in (dense[r] for r in rows)]
    (ip, ap), (iu, au) = _csr(own(positive)), _csr(own(unlabelled))
    p_row, u_row = np.repeat(np.arange(len(positive)), np.diff(ap)), np.repeat(np.arange(len(unlabelled)), np.diff(au))
    w, b, n_p, n_u, k = start[live], float(np.log(prior / (1 - prior))), len(positive), len(unlabelled), len(live)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        zp, zu = np.bincount(p_row, w[ip], n_p) + b, np.bincount(u_row, w[iu], n_u) + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            dp, du = prior * (sp - 1) / n_p - prior * sp / n_p, su / n_u
        else:
            dp, du = prior * sp / n_p, -su / n_u
        grad = np.append(np.bincount(ip, dp[p_row], k) + np.bincount(iu, du[u_row], k) + l2 * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0.0), b - float(step[-1])
    full = np.zeros(n)
    full[live] = w
    return full, b


def _counts(rows: list[np.ndarray], n: int) -> np.ndarray:
    """Texts that hold a feature, summed up in groups of texts."""
    total = np.zeros(n, np.int64)
    for at in range(0, len(rows), 256):
        total += np.bincount(np.concatenate(rows[at : at + 256]), minlength=n)
    return total


def _raw(rows: list[np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    return np.clip(np.array([w[r].sum() for r in rows]) + b, -30, 30)


def _start(positive, unlabelled, n: int, z: float = 4.5) -> np.ndarray:
    """Smoothed log ratios of the features that positives hold clearly more often than unlabelled texts (by z standard
    errors of the count expected of them); 0, and so left out of the model, for the rest."""
    cp, cu = _counts(positive, n), _counts(unlabelled, n)
    expected = cu * (len(positive) / max(1, len(unlabelled)))
    rp, ru = (cp + 0.5) / (len(positive) + 1), (cu + 0.5) / (len(unlabelled) + 1)
    return np.where(cp - expected > z * np.sqrt(expected + 1), np.log(rp / ru), 0.0)


def calibrate(raw: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Platt), by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    goal = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / ((label == 0).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = np.array([((p - goal) * raw).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = p * (1 - p) + 1e-6
        hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(d[0], -0.5, 0.5)), b - float(np.clip(d[1], -0.5, 0.5))
        if abs(d).max() < 1e-6:
            break
    return max(a, 1e-3), b


def _sample(df: DataFrame, rows: int, total: int, key: str, size: int = 0) -> DataFrame:
    """About `rows` of `total` rows, or FIT_BYTES of their `size` bytes, whichever is less, by a seeded hash of key."""
    share = min(1.0, rows / max(1, total), FIT_BYTES / max(1, size))
    return df.filter(F.pmod(F.xxhash64(F.lit(29), F.col(key).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", holdout=None) -> Model:
    """Fit on rows of labels that are not held out (holdout: a condition on column doc_id).

    Confirmed positives are documents labelled 1; unlabelled text is a sample of all documents; the class prior is the share
    of 1 among the training labels. Without any positive, the model gives every text a score of 0. Null labels count as
    unlabelled; a document labelled twice is positive if any of its labels is 1.
    """
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter("label IS NOT NULL AND doc_id IS NOT NULL")
    if holdout is not None:
        own = own.filter(~holdout)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sizes = slim.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    met = own.join(sizes, "doc_id", "left").groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count_distinct("doc_id").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    counts = {r.label: (r.n, r["size"]) for r in met.collect()}
    (n_pos, b_pos), (n_neg, b_neg) = counts.get(1, (0, 0)), counts.get(0, (0, 0))
    n_all = n_pos + n_neg
    if not n_pos:
        return Model(np.zeros(1 << BITS), -30.0, 1.0, 0.0)
    n_docs, b_docs = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    picked = _sample(own.filter("label > 0"), POSITIVES, n_pos, "doc_id", b_pos).unionByName(_sample(own.filter("label <= 0"), CALIBRATION, n_neg, "doc_id", b_neg))
    known = slim.join(F.broadcast(picked), "doc_id").select("label", "text")  # the sample is bounded
    free = _sample(slim, UNLABELLED, n_docs, "doc_id", b_docs).select(F.lit(-1).alias("label"), "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder()
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "ids": [np.sort(enc(t)).astype(np.int32).tobytes() for t in pdf["text"]]})

    # sorted feature ids, 4 bytes each, of at most POSITIVES + CALIBRATION + UNLABELLED texts or so
    rows = known.unionByName(free).mapInPandas(encode, "label int, ids binary").toPandas()
    rows = rows.sort_values(["label", "ids"])  # the order of tasks plays no part in the fit
    ids = {k: [np.frombuffer(x, np.int32) for x in g] for k, g in rows.groupby("label")["ids"]}
    positive, negative, unlabelled = ids.get(1, []), ids.get(0, []), ids.get(-1, [])
    if not positive:
        return Model(np.zeros(1 << BITS), -30.0, 1.0, 0.0)
    prior = min(0.9, max(1e-4, n_pos / n_all))
    w, b = fit_nnpu(positive, unlabelled or negative or positive, prior)
    raw = _raw(positive + negative, w, b)
    y = np.r_[np.ones(len(positive)), np.zeros(len(negative))]
    weight = n_pos / max(1, len(positive)), (n_all - n_pos) / max(1, len(negative))
    a, c = calibrate(raw, y)
    has_negative = bool(negative)
    del rows, ids, positive, negative, unlabelled
    release()  # the driver gives back what the fit has taken
    # the sample may hold more positives than the corpus
    c -= np.log(max(1e-6, weight[1] / weight[0])) if has_negative and abs(weight[1] / weight[0] - 1) > 1e-9 else 0.0
    return Model(w.astype(np.float32), float(b), float(a), float(c))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and score, a probability, one row per row of docs; nothing is shuffled. Null and empty texts have no evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    body = free_name(keep, "__text")
    slim = docs.select(*keep, F.col(text).alias(body))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, m = Encoder(), sent.value
        live = np.flatnonzero(m.weights)
        alive = np.zeros(len(m.weights), bool)
        alive[live] = True
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            raw = []
            for t in batch.column(len(keep)).to_pylist():
                if len(memo) > enc.LIMIT:
                    memo.clear()
                found: set[int] = set()
                for w in words_of(t):
                    got = memo.get(w)
                    if got is None:
                        got = memo[w] = tuple(f for f in features(w) if alive[f])
                    if got:
                        found.update(got)
                raw.append(np.fromiter(found, np.int64, len(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(m.scores(raw), pa.float64())], names=[*keep, "score"])
        del enc, memo
        release()

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(judge, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def detect(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", holdout=None, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, score and predicted (1 from the threshold on) of every document.

    Texts of any length are scored as a whole, null ones as empty ones. Repeated rows, and texts of the same words, are scored
    alike. Without labels no text is toxic. An empty table gives an empty result; columns beside those named are not read, and
    `keep` may not hold names of the result.
    """
    if clash := [c for c in keep if c.lower() in ("score", "predicted")]:
        raise ValueError(f"names of the result can't be kept columns: {clash}")
    model = train(docs, labels, text=text, doc_id=doc_id, label=label, holdout=holdout)
    return score(docs, model, text=text, keep=keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
