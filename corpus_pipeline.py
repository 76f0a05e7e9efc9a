"""A corpus from documents to token ids: quality, near-duplicates, repeated passages, benchmark passages, BPE.

Each stage is a function (spark, docs, sf_dir) over all that its predecessor kept. The first four return the columns of documents; the
last returns a row of token digests for each document that is left.

Defined cases, for all stages: decisions are made row by row; rows that repeat both doc_id and text are one document and share its fate,
and a text that is dropped leaves other texts of its doc_id alone. Columns beyond those of documents are dropped, whatever their names; an
empty table gives an empty table. By stage:

- quality: null is the empty text; without both labels in training all documents stay (see the operator); labels of unknown ids count for
  nothing, and of several labels for one id the smallest counts.
- near_duplicates: null and blank texts and rows without doc_id are linked with nothing and stay.
- substrings: null and blank texts become the empty text; rows without doc_id neither lose words nor take any from others.
- decontamination: null and blank texts have no words and stay; contaminated rows without doc_id go like others.
- bpe: null is the empty text; rows without doc_id are encoded like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm import decontam, neardup, quality, shared, substring, wordbpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _tagged(docs: DataFrame) -> DataFrame:
    """docs with text_hash, which tells texts of one doc_id apart."""
    return shared.pick(docs, *COLUMNS).withColumn("text_hash", F.xxhash64("text"))


def _without(tagged: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose doc_id (null equals null) and text_hash are not in dropped, which is broadcast only if its measured size is small."""
    gone = shared.durable(dropped.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    right = F.broadcast(gone) if gone.count() * 24 <= shared.BROADCAST_BYTES else gone
    same = tagged["doc_id"].eqNullSafe(right["gone_id"]) & (tagged["text_hash"] == right["gone_hash"])
    return tagged.join(right, same, "left_anti").select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, learned from labels, accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(shared.pick(docs, *COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    tagged = _tagged(docs)
    return _without(tagged, neardup.near_duplicates(tagged, keep=("text_hash",)).filter("not kept"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has; n_chars follows the new text."""
    out = substring.dedup_substrings(docs, keep=["lang", "source"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    tagged = _tagged(docs)
    found = decontam.decontaminate(tagged, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("text_hash",))
    return _without(tagged, found.filter("n_hit > 0"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of the documents that are left."""
    return wordbpe.digests(wordbpe.encode_decode(docs.select("doc_id", "text"), wordbpe.tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", one_of_each_group),
    ("substrings", repeated_passages),
    ("decontamination", benchmark_passages),
    ("bpe", token_ids),
]

#: SQL cannot express the classifier and the tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
