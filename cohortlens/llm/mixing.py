"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree (domain, language, source).  Each node's budget is shared among
its children by weight, no child getting more than its leaves hold in ``max_epochs`` passes; what
a child cannot take goes to its siblings by weight, and only what a whole family cannot
take goes to the siblings of their parent, because a node's capacity is the sum of its leaves'.
Each leaf then takes whole epochs, and of one more epoch, in an order seeded by epoch, the longest
prefix of documents within its budget.

Documents are never gathered per leaf: token sums per slice of the seeded order find the slice in which the
prefix ends, and only the documents of that slice are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storing import settled

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hexadecimal digits of the seeded order that make a slice.
SLICE_DIGITS = 3


@dataclass
class Level:
    """One level of the tree: its name, its value per document, and the integer weight of a node given its path."""

    name: str
    value: Column
    weight: Column


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parents: Sequence[str], key: str, budget: Column) -> DataFrame:
    """``nodes`` (parents, key, weight, capacity) with ``quota``: the budget of the parent by weight, up to the capacities.

    Children are saturated in the order of capacity per weight.  With C the capacities before a child and W the weights
    from it on, it is saturated if its capacity is at most (budget - C) * weight / W; the others share
    what is left by weight, rounded down.
    """
    family = Window.partitionBy(*parents)
    order = family.orderBy(F.col("capacity") / F.col("weight"), key)
    wide = nodes.withColumn("budget", budget.cast("decimal(20,0)")).select(
        "*", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(20,0)").alias("c"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("decimal(18,0)").alias("w"))
    full = wide.withColumn("full", F.col("capacity").cast("decimal(20,0)") * F.col("w")
                           <= (F.col("budget") - F.col("c")).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)"))
    rest = F.when(~F.col("full"), F.col("c"))
    level = full.select("*", F.min(rest).over(family).alias("c0"), F.max(F.when(~F.col("full"), F.col("w"))).over(family).alias("w0"))
    part = F.expr("cast((cast(budget - c0 as decimal(20,0)) * cast(weight as decimal(18,0))) div w0 as bigint)")
    return level.withColumn("quota", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("budget", "c", "w", "full", "c0", "w0", "weight", "capacity")


def quotas(leaves: DataFrame, levels: Sequence[str], budget: Column, max_epochs: int) -> DataFrame:
    """(levels, ``tokens``, ``quota``) of every leaf, from ``leaves`` (levels, ``w_<level>``, ``tokens``); small tables, one row per node."""
    leaves = leaves.withColumn("capacity", F.when(reduce(and_, [F.col(f"w_{n}") > 0 for n in levels]), F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("long"))
    total = leaves.agg(F.least(F.sum("capacity"), F.first(budget)).alias("b")).scalar()
    above: DataFrame | None = None
    for depth, name in enumerate(levels):
        path = list(levels[:depth + 1])
        nodes = (leaves.filter("capacity > 0").groupBy(*path).agg(F.max(f"w_{name}").cast("long").alias("weight"), F.sum("capacity").cast("long").alias("capacity")))
        if above is None:
            above = _share(nodes.withColumn("__all", F.lit(1)), ["__all"], name, total).drop("__all")
        else:
            nodes = nodes.join(above.withColumnRenamed("quota", "__b"), path[:-1])
            above = _share(nodes, path[:-1], name, F.col("__b")).drop("__b")
    return leaves.select(*levels, "tokens").join(above, list(levels))


def mix(df: DataFrame, levels: Sequence[Level], budget_share: tuple[int, int] = (1, 1), budget: int | None = None, max_epochs: int = 4,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(``id_col``, level names, kept columns, ``n_tokens``, ``epoch``), one row per selected document and epoch.

    Tokens are words.  The budget is a number of tokens, or ``budget_share`` (a fraction) of all tokens.
    A null level is a node of its own ("null"; other names start with "=").  Nodes of weight 0 or null get
    nothing; so do leaves without tokens.  Within a leaf, order ties (equal ids) go by number of tokens; rows equal
    in both are interchangeable.  Rounding down leaves at most a token per node unspent, and a prefix
    stops before the document that would exceed its budget.  An empty table gives an empty result.
    """
    names = [level.name for level in levels]
    keep = [c for c in keep if c not in (id_col, *names)]
    if {"n_tokens", "epoch"} & set(keep):
        raise ValueError("a kept column has the name of a result column")
    rows = df.select(F.col(id_col).alias("__id"), *[F.coalesce(F.concat(F.lit("="), level.value.cast("string")), F.lit("null")).alias(level.name) for level in levels],
                     *[F.coalesce(level.weight, F.lit(0)).cast("long").alias(f"w_{level.name}") for level in levels],
                     word_count(F.col(text_col)).alias("n_tokens"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    if not keep:
        rows = settled(rows, "mixing")
    leaves = rows.groupBy(*names).agg(*[F.max(f"w_{n}").alias(f"w_{n}") for n in names], F.sum("n_tokens").alias("tokens"))
    leaves = settled(leaves, "mixing-leaves")
    share = F.expr(f"cast(sum(tokens) * {budget_share[0]} div {budget_share[1]} as bigint)") if budget is None else None
    total = leaves.agg(share.alias("b")).scalar() if share is not None else F.lit(budget).cast("long")
    plan = quotas(leaves, names, total, max_epochs).filter("quota > 0 and tokens > 0")
    plan = plan.select(*names, F.expr("cast(quota div tokens as int)").alias("__full"), (F.col("quota") % F.col("tokens")).alias("__rest"))
    plan = settled(plan, "mixing-quotas")  # one row per leaf
    drawn = rows.join(plan, names)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__full").cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit("null"))))
    drawn = drawn.withColumn("__h", order).withColumn("__slice", F.substring("__h", 1, SLICE_DIGITS))
    upto = Window.partitionBy(*names).orderBy("__slice")
    sums = drawn.groupBy(*names, "__slice", "__rest").agg(F.sum("n_tokens").alias("__t"))
    sums = sums.withColumn("__upto", F.sum("__t").over(upto)).filter("__upto > __rest")
    ends = sums.groupBy(*names).agg(F.min(F.struct("__slice", "__upto", "__t")).alias("e"))
    ends = settled(ends.select(*names, F.col("e.__slice").alias("__end"), (F.col("e.__upto") - F.col("e.__t")).alias("__before")), "mixing-ends")
    out = [F.col("__id").alias(id_col), *names, *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens"]
    drawn = drawn.join(ends, names)
    # All rows of whole epochs, and of the further epoch those of the slices before its end, with no exchange.
    early = F.col("__slice") < F.col("__end")
    sure = drawn.filter((F.col("__full") > 0) | early).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.col("__full") - F.when(early, 0).otherwise(1))))
    edge = drawn.filter("__slice = __end")
    running = Window.partitionBy(*names).orderBy("__h", "__id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("__run", F.sum("n_tokens").over(running) + F.col("__before")).filter("__run <= __rest").withColumn("epoch", F.col("__full"))
    return sure.select(*out, "epoch").unionByName(edge.select(*out, "epoch"))
