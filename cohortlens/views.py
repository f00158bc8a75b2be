"""The engine's input tables as views over the given star-schema tables.

Orders are records, customers are patient groups, line items are windows,
events are signal samples, embeddings are record features, documents are record
contents.  Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import argmax_label, fuse, string_list
from .operators.indexing import running_before
from .sources.tables import table

FINE = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
COARSE = ["Normal", "Abnormal", "Reject"]
CLASSES = {"T2-1": COARSE, "T2-2": FINE}
NORMAL = {"T2-1": "Normal", "T2-2": "1-URGENT"}
SENSITIVE = {"T2-1": ["Abnormal"], "T2-2": ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]}
SPLITS = ["train2022", "test2022", "test2023"]
METHODS = ["CLS", "TG", "Fusion"]
PHASES = {"CLS": "phase1", "TG": "phase2", "Fusion": "phase3"}
FEATURE_DIM = 64
WINDOW_DIM = 4
BINARY_LABELS = ["even", "odd"]
QUARTER_LABELS = ["q0", "q1", "q2", "q3"]


def coarse(label: Column) -> Column:
    return F.when(label == "1-URGENT", F.lit("Normal")).when(label == "5-LOW", F.lit("Reject")).otherwise(F.lit("Abnormal"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    year = F.year("o_orderdate")
    low = F.col("o_orderpriority") == "5-LOW"
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group_id"), year.alias("yr"),
        F.when(year == 1995, F.lit("train2022")).when(year <= 1997, F.lit("test2022")).otherwise(F.lit("test2023")).alias("split"),
        F.col("c_mktsegment").alias("device"), F.col("o_orderpriority").alias("fine_label"),
        coarse(F.col("o_orderpriority")).alias("coarse_label"),
        F.when(low, F.lit("excluded")).otherwise(F.lit("included")).alias("inclusion_status"),
        F.when(low, F.lit("poor_quality_only")).alias("exclusion_reason"))


def _probabilities(method_index: int) -> Column:
    """Five class probabilities of one method, computed inside the record's row."""
    raw = [f"((record_id * 7919 + {j * 104729 + method_index * 15485863 + 13}) % 1000 + 1 + if(fine_label = '{name}', 600, 0))"
           for j, name in enumerate(FINE)]
    total = f"cast({' + '.join(raw)} as double)"
    return F.expr("array(" + ", ".join(f"cast({r} as double) / {total}" for r in raw) + ")")


def score_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with both methods' probabilities side by side."""
    return records(spark, folder).select(
        "record_id", "group_id", "split", F.col("fine_label").alias("y_true"),
        _probabilities(0).alias("p_first"), _probabilities(1).alias("p_second"))


def scores(spark: SparkSession, folder: str, fused: bool = True) -> DataFrame:
    """One row per (record, method) with class order and probabilities; optionally with the even fusion."""
    # A readout is a weight of the first branch; 1 and 0 give the branches themselves, exactly.
    weights = {"CLS": 1.0, "TG": 0.0, "Fusion": 0.5} if fused else {"CLS": 1.0, "TG": 0.0}
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(w).alias("weight")) for m, w in weights.items()])
    spread = score_pairs(spark, folder).select("*", F.inline(kinds))
    return spread.select("record_id", "group_id", "split", "y_true", string_list(FINE).alias("class_order"), "method",
                         fuse(F.col("p_first"), F.col("p_second"), F.col("weight"), len(FINE)).alias("probabilities"))


def stored_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Two methods as stored by their producers: the second one lists its classes in reverse."""
    turned = F.col("method") == "TG"
    return scores(spark, folder, fused=False).withColumns({
        "class_order": F.when(turned, F.reverse("class_order")).otherwise(F.col("class_order")),
        "probabilities": F.when(turned, F.reverse("probabilities")).otherwise(F.col("probabilities"))})


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted labels per (dataset, evaluation, task, method, record); the coarse task merges the fine labels."""
    labelled = scores(spark, folder).select(
        "record_id", "group_id", F.col("split").alias("evaluation"), "method", "y_true",
        argmax_label(F.col("class_order"), F.col("probabilities")).alias("y_pred"))
    tasks = F.array(
        F.struct(F.lit("T2-1").alias("task"), coarse(F.col("y_true")).alias("y_true"), coarse(F.col("y_pred")).alias("y_pred")),
        F.struct(F.lit("T2-2").alias("task"), F.col("y_true"), F.col("y_pred")))
    phase = F.lit(None).cast("string")
    for method, name in PHASES.items():
        phase = F.when(F.col("method") == method, F.lit(name)).otherwise(phase)
    return labelled.select(
        F.when(F.col("evaluation") == "test2023", F.lit("Set2023")).otherwise(F.lit("Set2022")).alias("dataset"),
        "evaluation", "method", phase.alias("phase"), "record_id", "group_id", F.inline(tasks))


def drawn_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of the resampled split, all patients of both tasks."""
    return drawn(predictions(spark, folder))


def drawn(rows: DataFrame) -> DataFrame:
    return rows.filter("evaluation = 'test2022'")


def windows(spark: SparkSession, folder: str, indexed: bool = True) -> DataFrame:
    """Line items as windows with four feature dimensions, numbered inside each record."""
    lines = table(spark, folder, "lineitem")
    features = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features")
    if not indexed:
        return lines.select(F.col("l_orderkey").alias("record_id"), F.col("l_quantity").alias("frames"), features)
    order, values = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = lines.select(F.col("l_orderkey").alias("record_id"), *order, *values)
    # The vector is made afterwards, and of the order only the place is stored.
    numbered = running_before(rows, [F.col(c) for c in [*order, "l_quantity"]], "window_index", keys=["record_id"], keep=["record_id", *values])
    return numbered.select("record_id", "window_index", F.col("l_quantity").alias("frames"), features)


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """Events as samples, numbered per user in time order."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("record_id"), "ts", "event_id", "value")
    numbered = running_before(events, [F.col("ts"), F.col("event_id")], "sample_index", keys=["record_id"], keep=["record_id", "value"])
    return numbered.select("record_id", "sample_index", "value")


def board(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer as a published system with a score."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.when(key % 2 == 0, F.lit("test2022")).otherwise(F.lit("test2023")).alias("evaluation"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("T2-1")).otherwise(F.lit("T2-2")).alias("task"),
        F.when(key % 3 == 0, F.lit("Table III")).otherwise(F.lit("Table II")).alias("table"),
        F.col("c_name").alias("team"), ((F.col("c_acctbal") + 1000.0) / 11000.0).alias("score"))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("dataset"),
        F.when(F.col("l_linestatus") == "O", F.lit("Abnormal")).otherwise(F.lit("Normal")).alias("binary_label"),
        (F.col("l_discount") >= 0.05).alias("overlap"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as record features; groups of five records never straddle a split."""
    group = F.expr("vec_id div 5")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("record_id"), group.alias("group_id"), "label",
        F.element_at(string_list(BINARY_LABELS), F.col("label") % 2 + 1).alias("binary_label"),
        F.element_at(string_list(QUARTER_LABELS), F.col("label") % 4 + 1).alias("coarse_label"),
        F.when(group % 10 < 6, F.lit("train")).when(group % 10 < 8, F.lit("test2022")).otherwise(F.lit("test2023")).alias("split"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    hashed = docs.select("doc_id", "source", F.sha2("text", 256).alias("content"))
    return hashed.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("group_id"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"), "content", "quality", "toxic")
