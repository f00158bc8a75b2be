"""Record manifests: projections, splits, folds, distributions and identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .indexing import running_before, sorted_position

#: Groups that one task places one after another.
HEAD = 512


def public_projection(records: DataFrame, columns: Sequence[str], optional: Sequence[str] = (),
                      renames: Mapping[str, str] | None = None) -> DataFrame:
    """Whitelisted columns, optional ones only where present, then renames."""
    kept = [c for c in columns if c not in optional or c in records.columns]
    return records.select(*kept).withColumnsRenamed(dict(renames or {}))


def included(records: DataFrame) -> DataFrame:
    return records.filter(F.col("inclusion_status") == "included")


def official_split(records: DataFrame, train: str, test: str, name: str = "official_split") -> DataFrame:
    """Split ``test`` by whether the record's group also occurs in ``train``."""
    groups = (records.filter(F.col("split") == train).select("group_id").distinct()
              .withColumn("__seen", F.lit(True)))
    return (records.join(groups, "group_id", "left")
            .withColumn(name, F.when(F.col("split") != test, F.col("split"))
                        .when(F.col("__seen"), F.lit("test_intra")).otherwise(F.lit("test_inter")))
            .drop("__seen"))


def normalise_keys(records: DataFrame, datasets: Mapping[str, str], other: str) -> DataFrame:
    """Dataset name from the split, both test parts merged again, lower-cased evaluation."""
    name = F.lit(other)
    for split, dataset in datasets.items():
        name = F.when(F.col("official_split") == split, F.lit(dataset)).otherwise(name)
    merged = F.when(F.col("official_split").isin("test_inter", "test_intra"), F.lit("test2022")).otherwise(
        F.col("official_split"))
    return (records.withColumn("dataset", name).withColumn("split", merged)
            .withColumn("evaluation", F.lower("dataset")))


def dataset_records(records: DataFrame, dataset: str) -> DataFrame:
    return records.filter(F.col("dataset") == dataset).withColumn("split", F.col("official_split"))


def evaluation_splits(records: DataFrame, mapping: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Held-out rows under their (dataset, evaluation) name; ``mapping`` holds (split, dataset, evaluation)."""
    wanted = [split for split, _, _ in mapping]
    dataset, evaluation = F.lit(None).cast("string"), F.lit(None).cast("string")
    for split, d, e in mapping:
        dataset = F.when(F.col("split") == split, F.lit(d)).otherwise(dataset)
        evaluation = F.when(F.col("split") == split, F.lit(e)).otherwise(evaluation)
    return (records.filter(F.col("split").isin(wanted))
            .withColumn("dataset", dataset).withColumn("evaluation", evaluation))


def exclusion_accounting(records: DataFrame) -> DataFrame:
    """Excluded records by reason, with the grand total as reason ``total``."""
    out = records.filter(F.col("inclusion_status") == "excluded")
    return (out.rollup("exclusion_reason").agg(F.count("*").alias("records"), F.grouping("exclusion_reason").alias("g"))
            .select(F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("exclusion_reason")).alias("exclusion_reason"),
                    "records"))


def cross_split_duplicates(records: DataFrame, content: str, split: str, train: str, held_out: str) -> DataFrame:
    """Train records whose exact content also occurs in the held-out split.

    The held-out side is reduced to one row per content first, so a text copied
    many times costs one match per train copy and never all pairs.
    """
    held = (records.filter(F.col(split) == held_out).groupBy(content)
            .agg(F.count("*").alias("held_out_copies")))
    return records.filter(F.col(split) == train).join(held, content)


def _placed(weights: Sequence[float], loads: Sequence[Sequence[float]], step: int):
    """Fold after fold for the groups of one bucket, from given class counts per fold; a group counts ``step`` times."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        held = np.array(loads, float)
        counts = np.array(table["counts"].to_pylist(), float)
        turn = np.arange(len(held)) - table["bucket"][0].as_py() if len(table) else 0
        found = []
        for v in counts:
            # The sum of the squared class shares grows by the group's own part and twice this.
            score = sum(held[:, c] * v[c] * w for c, w in enumerate(weights))
            fold = int(np.lexsort((turn % len(held), held.sum(1), score))[0])
            held[fold] += step * v
            found.append(fold)
        return table.select(["group_id", "counts"]).append_column("fold_id", pa.array(found, pa.int32()))
    return run


def grouped_stratified_folds(records: DataFrame, label: str, train: Column, folds: int = 5) -> DataFrame:
    """``fold_id`` for the train rows so that whole groups stay together and classes stay balanced; -1 elsewhere.

    Groups are taken with the largest spread of class counts first (ties by hash and id), and each goes to the fold where it adds
    least to the squared class shares; then to the smaller fold.  The first ``HEAD`` groups go one by one.  The others are dealt out to
    buckets of at most ``HEAD`` in that order; a bucket starts from the counts after the first groups and takes each of its groups for as many as
    there are buckets, so all buckets even out what the first groups left.  A task has one bucket, whatever the number of groups.
    A null group or label is a group or class like any other.
    """
    sizes = stored(records.filter(train).groupBy("group_id", F.col(label).alias("y")).agg(F.count("*").alias("n")), "fold-sizes")
    # One row per class.
    totals = sorted(((r.y, r.n) for r in sizes.groupBy("y").agg(F.sum("n").alias("n")).collect()), key=lambda t: (t[0] is not None, t[0]))
    weights = [1.0 / (float(n) * float(n)) for _, n in totals]
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("y").eqNullSafe(F.lit(y)), F.col("n"))), F.lit(0)) for y, _ in totals]).cast("array<long>")
    squares, whole = F.aggregate("counts", F.lit(0.0), lambda t, x: t + x * x.cast("double")), F.aggregate("counts", F.lit(0.0), lambda t, x: t + x)
    groups = sizes.groupBy("group_id").agg(counts.alias("counts")).withColumn("spread", squares * len(totals) - whole * whole)
    order = [-F.col("spread"), F.md5(F.col("group_id").cast("string")), F.col("group_id")]
    ranked = stored(running_before(groups.select("group_id", "counts", "spread"), order, "at").drop("spread"), "fold-groups")
    buckets = max(1, -(-(ranked.count() - HEAD) // HEAD))
    kind = f"group_id {groups.schema['group_id'].dataType.simpleString()}, counts array<long>, fold_id int"

    def dealt(part: Column, bucket: Column, loads: Sequence[Sequence[float]], step: int) -> DataFrame:
        return ranked.filter(part).withColumn("bucket", bucket.cast("long")).groupBy("bucket").applyInArrow(_placed(weights, loads, step), kind)

    first = stored(dealt(F.col("at") < HEAD, F.lit(0), [[0.0] * len(totals)] * folds, 1), "fold-head")
    sums = first.groupBy("fold_id").agg(F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(len(totals))]).alias("load")).collect()
    loads = {r.fold_id: [float(x) for x in r.load] for r in sums}  # one row per fold
    rest = dealt(F.col("at") >= HEAD, F.pmod(F.col("at") - HEAD, F.lit(buckets)), [loads.get(j, [0.0] * len(totals)) for j in range(folds)], buckets)
    found = first.unionByName(rest).select(F.col("group_id").alias("__group"), F.col("fold_id").alias("__fold"))
    return (records.withColumn("__train", F.coalesce(train, F.lit(False))).join(found, F.col("group_id").eqNullSafe(F.col("__group")), "left")
            .withColumn("fold_id", F.when(F.col("__train"), F.col("__fold")).otherwise(F.lit(-1)).cast("int")).drop("__train", "__group", "__fold"))


def custom_order(records: DataFrame, column: str, order: Sequence[str], name: str = "ord") -> DataFrame:
    """Explicit rank of a declared value order, for sorting by it."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return records.withColumn(name, (place - 1).cast("int"))


def sequential_ids(names: DataFrame, column: str, pattern: str) -> DataFrame:
    """Sorted distinct names numbered from 1 and formatted, e.g. ``record_%05d``."""
    numbered = sorted_position(names.select(column).distinct(), [column], "at")
    return numbered.select(column, F.format_string(pattern, F.col("at") + 1).alias("record_name"))


def global_window_index(windows: DataFrame, batch_size: int = 32) -> DataFrame:
    """Record-major running index over all windows, and the batch each falls into.

    Window counts are combined per record, so the running total is over records only.
    """
    per_record = windows.groupBy("record_id").agg(F.count("*").alias("n"))
    starts = running_before(per_record, [F.col("record_id")], "start", value=F.col("n"))
    indexed = windows.join(starts.select("record_id", "start"), "record_id")
    return (indexed.withColumn("global_window_index", F.col("start") + F.col("window_index")).drop("start")
            .withColumn("batch_id", F.expr(f"global_window_index div {batch_size}")))


def first_n(records: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return records.orderBy(*order).limit(n)
