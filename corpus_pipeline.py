"""A pipeline over ``documents``: quality classifier, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last
return the columns of ``documents``.  Each works on all that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import mixing as budgets
from cohortlens.llm import unigram
from cohortlens.llm.overlap import similar_groups
from cohortlens.llm.queries import target_levels
from cohortlens.llm.repeats import remove_repeats
from cohortlens.llm.rule_ensemble import classify
from cohortlens.llm.storing import settled, small_batches_for
from cohortlens.session import tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be good; fitted to the labels of the documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, keep=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest (id, SHA-256 of the text); null ids come last.

    Candidates are texts with SimHash fingerprints within four bits, as in operator 8, and texts that share a min-hash band, for the pairs
    that four bits miss.  Near-duplicates have four fifths or more of their five-word shingles in common (Jaccard), checked on the shingle sets.
    """
    groups = settled(similar_groups(docs, distance=4), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.coalesce("digest", F.lit("")).alias("digest"))
    first = groups.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("__i"), F.col("first.digest").alias("__d"))
    marked = docs.withColumn("__digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    # The rest of a group leaves before its rows are compared again; what is left to drop are rows equal in id and text.
    kept = marked.join(first, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__digest"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop words of passages of 20 words that occur earlier; a document of which nothing is left goes."""
    cleaned = remove_repeats(docs.select(*COLUMNS, F.col("text").alias("whole")), keep=["whole", "lang", "source", "n_chars"])
    same = F.col("n_removed") == 0
    return (cleaned.filter((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
            .select("doc_id", F.when(same, F.col("whole")).otherwise(F.col("kept_text")).alias("text"), "lang", "source",
                    F.when(same, F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, five quarters of all tokens in at most four epochs; one row per document and epoch."""
    given = docs.select("doc_id", "text", F.struct("lang", "source").alias("given"), "n_chars")
    mixed = budgets.mix(given.select("*", "given.lang", "given.source"), target_levels(), budget_share=(5, 4), max_epochs=4, seed=1,
                        keep=["text", "given", "n_chars"])
    return mixed.select("doc_id", "text", "given.lang", "given.source", "n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with what they decode to compared to the text."""
    small_batches_for(spark)
    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    coded = unigram.encode(docs.select(*COLUMNS), model, keep=["lang", "source", "n_chars"], check=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "n_byte_tokens", "ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classifier), ("simhash near-dedup", near_copies), ("substring dedup", repeats),
    ("mixing to target weights", mixing), ("sentencepiece encoding", encoding)]

#: A fitted classifier and a tokeniser have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
