"""The corpus pipeline: five stages from raw documents to encoded ones, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisweave.llm.common import read_table, written
from basisweave.llm.decontaminate import decontaminate
from basisweave.llm.line_dedup import drop_repeated_lines
from basisweave.llm.sentencepiece_sampling import sample_segmentations
from basisweave.llm.simhash_dedup import drop_near_duplicates
from basisweave.llm.toxicity import production_model, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    docs = docs.select(*COLUMNS)
    model = production_model(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, out="_score").where("_score < 0.7").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents stay in the first alone; a document that loses all its text goes."""
    out = drop_repeated_lines(docs.select(*COLUMNS), min_docs=10, keep_first=True)
    emptied = F.col("kept_text").isNotNull() & ~F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]")
    text = F.coalesce("kept_text", "text")
    return out.where(~emptied).withColumn("text", text).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs.select(*COLUMNS), width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    keyed = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("_key"))
    hit = decontaminate(keyed.select("_key", "text"), read_table(spark, sf_dir, "benchmark"), id_col="_key").where("n_hit > 0").select(F.col("id").alias("_hit"))
    return keyed.join(hit, keyed["_key"].eqNullSafe(hit["_hit"]), "left_anti").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its best two distinct sampled segmentations, or the one there is."""
    out = sample_segmentations(docs.select(*COLUMNS), k=2, keep=["doc_id", "lang", "source", "n_chars"])
    first, second = F.get("samples", F.lit(0)), F.get("samples", F.lit(1))
    return out.select("doc_id", "lang", "source", "n_chars", first["ids"].alias("piece_ids"), F.size(first["ids"]).cast("long").alias("n_pieces"), first["log_prob"].alias("log_prob"), first["inclusion"].alias("inclusion"), second["ids"].alias("other_piece_ids"), second["log_prob"].alias("other_log_prob"), F.col("exact").alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Learning, components and sampling have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE_SQL_BY_QUERY: dict[str, str] = {}
