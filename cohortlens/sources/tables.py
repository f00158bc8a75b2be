"""Readers: text manifests, result payloads, feature and draw tables, file listings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.slots import in_long_form


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given input table.  Its schema is inferred once per path, which saves a job per later read."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Headed CSV, plain or gzip, read as text and cast once to the declared types.

    A gzip file cannot be split, so many files and not one big one give parallel reads.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def read_payload(spark: SparkSession, path: str, row_schema: str, multi_line: bool = False) -> DataFrame:
    """``{"label", "rows": [...]}`` documents to one row per table row.

    ``multi_line`` reads indented files of one document each; otherwise each line is a document.
    """
    docs = spark.read.schema(f"label string, rows array<struct<{row_schema}>>").json(path, multiLine=multi_line)
    return docs.select("label", F.inline("rows"))


def read_features(spark: SparkSession, path: str, dim: int, vector: str = "features") -> DataFrame:
    """Feature table whose vectors must have the declared dimension."""
    rows = spark.read.parquet(path)
    return with_dimension(rows, dim, vector)


def with_dimension(rows: DataFrame, dim: int, vector: str = "features") -> DataFrame:
    kept = rows.schema[vector].dataType.simpleString()
    return rows.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(
        F.raise_error(F.lit(f"feature dimension is not {dim}")).cast(kept)))


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """Stored draw pieces ``(task, draw, first_slot, patients array)`` to the long form ``(task, draw, slot, patient_index)``."""
    rows = spark.read.schema("task string, draw long, first_slot long, patients array<long>").parquet(path)
    return in_long_form(rows)


def file_inventory(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Files below ``root`` by suffix with name, stem and size; the contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*{suffix}").load(root).select("path", "length"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
                        F.element_at(F.split("path", "/"), -2).alias("folder"))


def duplicate_files(files: DataFrame, column: str = "stem") -> DataFrame:
    return files.groupBy(column).agg(F.count("*").alias("files")).filter("files > 1")
