"""The training-corpus pipeline over documents: five stages, each written as Parquet and read again by the next.

quality -> exact_dedup -> near_dedup -> decontaminate -> pack. All but the last return the columns of documents. A
document that the quality classifier rejects goes; of equal texts the one with the largest doc_id stays, of near
duplicates the one with the smallest; a document that holds a benchmark window goes; what is left is packed.

A row is known by its id and its text together: of rows that share an id, those with other texts are judged apart, and
rows without an id are judged by their text (a copy of a text that has an id goes). Rows that repeat both stay or go
together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import best_fit, exact_dedup, near_dedup, quality, suffix_decontam
from corpusloom.llm.queries_free import tokenizer_definition
from corpusloom.storage import materialize

#: Dropped rows that are broadcast at most, of 40 bytes each.
BROADCAST_ROWS = 250_000


def _kept(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the rows that groups (doc_id, text_sha256, kept) drops: a row is known by its id and its text."""
    dropped = groups.where("NOT kept").select("doc_id", F.unhex("text_sha256").alias("sha")).distinct()
    gone = materialize(dropped, "dropped")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == gone["sha"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, exact_dedup.exact_groups(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8 or more."""
    return _kept(docs, near_dedup.near_groups(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = materialize(best_fit.token_pieces(docs, tokenizer_definition()), "pieces")
    return best_fit.pack_pieces(pieces)[0].select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: Classifier, sketches and tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
