"""A training corpus from raw documents, in five stages; each is written as Parquet and read again as the next one's input.

Documents are known by doc_id: where a stage rejects a document, all rows of that doc_id go. Columns beside those of
`documents` don't come in. Null and empty texts pass the filters; they have no words to be taken by the mix. Texts of any
length are read as a whole; an empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from textloom.llm.common import crc_mod, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: five-word shingles, a Jaccard similarity of 0.8.
SHINGLE, PERCENT = 5, 80
BROADCAST_IDS = 1 << 21


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids (column `gone`) of a table written before; the ids are sent to the tasks if they are few (counted)."""
    ids = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold by a model of the labels that are not held out. A null text is scored as an empty one; rows of equal texts have equal scores."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), holdout=crc_mod("doc_id", 4) == 2)
    return toxicity.score(docs, model, keep=COLUMNS).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines found in three or more documents but in the one of the largest doc_id. A null text becomes an empty one; n_chars is counted anew."""
    kept = line_dedup.dedup_lines(docs, extra=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays; of rows of one doc_id and text, one."""
    docs = docs.select(*COLUMNS)
    found = materialise(ngram_join.join_components(docs, n=SHINGLE, percent=PERCENT), "found")
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    kept = _without(docs, gone)
    twice = materialise(found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone")), "twice")
    if not twice.head(1):
        return kept.select(*COLUMNS)
    again = kept.join(twice, F.col("doc_id") == F.col("gone")).select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return _without(kept, twice).select(*COLUMNS).unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id has no contaminated row. Null texts have no words and are clean, as all rows are beside an empty benchmark."""
    docs = docs.select(*COLUMNS)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = materialise(found.filter("contaminated").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return _without(docs, gone).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size and taken (words; repeats counted). Null and empty texts have no words and are not taken; of rows of one id and size the order of their texts' hashes says which are, repeated rows are documents of their own."""
    mixed, _ = mixing.mix(docs, extra=COLUMNS[1:])
    return mixed.filter("taken > 0").select(*COLUMNS, "size", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The toxicity classifier can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
