"""Quality classifier: a sparse ensemble of rules over text statistics.

A forest of shallow trees is fitted to labelled documents; every path from a root to a node is a
conjunctive rule.  Lasso logistic regression weighs the rules, and those with a weight are
compiled into one Spark column expression, so scoring is a projection over the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import log
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import with_statistics
from .storing import settled

#: Labelled rows that a fit takes at most; beyond it, rows are chosen by a hash of their id.
MOST_ROWS = 100_000
TREES, DEPTH, PENALTY = 24, 3, 0.002

Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold
Rule = tuple[Condition, ...]


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """Statistics of a text as the classifier sees them, never null."""
    return {
        "log_words": F.log1p("n_words"), "word_length": _share("word_chars", "n_words"), "longest_word": F.col("longest_word").cast("double"),
        "symbol_share": _share("n_symbols", "word_chars"), "repeated_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"), "distinct_words": _share("n_distinct_words", "n_words"),
        "words_per_line": _share("n_words", "n_lines"), "digit_share": _share("n_digits", "word_chars"),
        "upper_share": _share("n_upper", "word_chars"), "stops_per_word": _share("n_stops", "n_words"),
        "bytes_per_char": _share("n_bytes", "n_code_points")}


def condition(c: Condition) -> Column:
    name, sign, threshold = c
    value = features()[name]
    return value <= F.lit(threshold) if sign == "<=" else value > F.lit(threshold)


def compiled(rule: Rule) -> Column:
    return reduce(and_, map(condition, rule))


def simplified(path: Sequence[Condition]) -> Rule:
    """The same conjunction with one bound per feature and direction, in a fixed order."""
    bounds: dict[tuple[str, str], float] = {}
    for name, sign, threshold in path:
        tight = min if sign == "<=" else max
        bounds[name, sign] = tight(bounds.get((name, sign), threshold), threshold)
    return tuple(sorted((n, s, t) for (n, s), t in bounds.items()))


BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(description: str, names: Sequence[str]) -> list[Rule]:
    """Rules of all nodes below the root, from a tree's printed form (one branch condition per line, nested by indentation)."""
    found, stack = [], []
    for line in description.splitlines():
        if m := BRANCH.match(line):
            depth = len(m[1])
            stack = [(d, c) for d, c in stack if d < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            found.append(simplified([c for _, c in stack]))
    return found


@dataclass
class RuleEnsemble:
    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(compiled(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(id_col: str, folds: int = 5) -> Column:
    """True where the checksum of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most_rows: int = MOST_ROWS) -> RuleEnsemble:
    """Fit to the rows of ``statistics`` that have a label 0 or 1 and are not held out.

    Rows without label, and labels of other values, take no part.  With one class or none the score is constant:
    the smoothed share of label 1.
    """
    given = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).distinct()
    total = given.count()
    if total > most_rows:
        given = given.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most_rows / total)))
    names = list(features())
    rows = (statistics.withColumnRenamed(id_col, "__id").join(given, "__id")
            .select("__y", *[c.alias(f"__f{i}") for i, c in enumerate(features().values())]))
    rows = settled(rows.coalesce(24), "labelled")
    classes = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    ones, zeros = classes.get(1.0, 0), classes.get(0.0, 0)
    if not ones or not zeros:
        return RuleEnsemble(log((ones + 1) / (zeros + 1)))
    vectors = rows.select("__y", array_to_vector(F.array(*[f"__f{i}" for i in range(len(names))])).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="__y", numTrees=TREES, maxDepth=DEPTH, seed=1, minInstancesPerNode=5,
                                    featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({r for tree in forest.trees for r in paths(tree.toDebugString, names)})
    if not rules:
        return RuleEnsemble(log(ones / zeros))
    at = {n: F.col(f"__f{i}") for i, n in enumerate(names)}

    def holds(rule: Rule) -> Column:
        return reduce(and_, [at[n] <= F.lit(t) if s == "<=" else at[n] > F.lit(t) for n, s, t in rule]).cast("double")
    matrix = rows.select("__y", array_to_vector(F.array(*map(holds, rules))).alias("x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="__y", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(matrix)
    return RuleEnsemble(lasso.intercept, {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray()) if w})


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
             threshold: float = 0.3) -> DataFrame:
    """(``id_col``, kept columns, ``held_out``, ``score``, ``predicted``) for every row, whole texts.

    Fitted to the labels of documents in ``df`` that are not held out.  Null and empty texts have all counts
    zero and get a score like any other.  Repeated rows give repeated rows, an empty table an empty result.
    A kept column may be the text itself; it may not have a result column's name.
    """
    keep = [c for c in keep if c != id_col]
    if {"held_out", "score", "predicted"} & set(keep):
        raise ValueError("a kept column has the name of a result column")
    named = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    stats = settled(with_statistics(named.select("__id", "__text"), "__text", keep=["__id"]), "statistics")
    model = fit(stats, labels.withColumnRenamed(id_col, "__id"), "__id")
    # Kept columns, texts among them, are not stored beside the counts: they pass by a second count of their own.
    counted = with_statistics(named, "__text", keep=["__id", *[f"__k{i}" for i in range(len(keep))]]) if keep else stats
    scored = counted.withColumn("__score", model.score())
    return scored.select(F.col("__id").alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
                         held_out("__id").alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= threshold).cast("int").alias("predicted"))
