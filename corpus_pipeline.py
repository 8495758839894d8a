"""Corpus pipeline: each stage is one operator over all that the stage before it kept.

Every function takes (spark, docs, sf_dir); all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm.common import crc_mod, fresh, text_key
from tallyrank.llm.decontaminate import find_contamination
from tallyrank.llm.near_join import text_classes
from tallyrank.llm.packing import pack, pieces
from tallyrank.llm.repeated_passages import remove_repeats
from tallyrank.llm.toxicity import fit_toxicity
from tallyrank.session import discard, materialize, scratch_path, scratch_scope, write_cut

#: A document goes if its toxicity score is this or more.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC. Labels train on the same rows as the toxicity query."""
    score = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 3) != 1)
    name = fresh(docs, "_toxicity")
    return docs.withColumn(name, score).filter(F.col(name) < TOXIC).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null ids last.

    Groups are of texts, so rows that repeat an id belong to the groups of their own texts. Of
    rows that repeat a group's smallest id the first one written stays.
    """
    row = fresh(docs, "_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    _, classes = text_classes(numbered)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("bigint").alias("id"), F.col(row).alias("row"))
    # first of each text, then of each group: large groups are merged before any row moves
    first = numbered.select(text_key().alias("key"), order.alias("first")).groupBy("key").agg(F.min("first").alias("first"))
    kept = first.join(classes, "key").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; n_chars follows where the text changed."""
    before = fresh(docs, "_before")
    out = remove_repeats(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    name = fresh(docs, "_contamination")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), result=name)
    return found.filter(F.col(name)["n_hit"] == 0).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024 tokens."""
    return pack(pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained scores, tokens and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept: list[str] = []
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(kept):  # frees what the stage wrote for itself
            docs = write_cut(stage(spark, docs, sf_dir), path)
        for before in kept:
            discard(before)
        kept = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
