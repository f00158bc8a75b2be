"""Expressions over array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def double_list(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def argmax_label(class_order: Column, probabilities: Column) -> Column:
    """Class at the first maximum, so ties go to the earlier declared class."""
    return F.element_at(class_order, F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def reorder(probabilities: Column, source: Column, target: Sequence[str]) -> Column:
    """Permute ``probabilities`` from ``source`` order into the declared ``target`` order."""

    def pick(name: str) -> Column:
        place = F.array_position(source, F.lit(name)).cast("int")
        return F.when(place > 0, F.element_at(probabilities, place)).otherwise(
            F.raise_error(F.lit(f"missing class: {name}")).cast("double"))

    return F.array(*[pick(name) for name in target])


def fuse(first: Column, second: Column, alpha: Column | float, size: int | None = None) -> Column:
    """``alpha * first + (1 - alpha) * second`` element by element.

    With the number of classes given the sum is written out per class, which stays
    in generated code; otherwise a higher-order function handles any length.
    """
    if not isinstance(alpha, Column):
        if not 0.0 <= alpha <= 1.0:
            raise ValueError("alpha must lie in [0, 1]")
        alpha = F.lit(float(alpha))
    rest = F.lit(1.0) - alpha
    if size is None:
        return F.zip_with(first, second, lambda a, b: alpha * a + rest * b)
    return F.array(*[alpha * F.get(first, F.lit(i)) + rest * F.get(second, F.lit(i)) for i in range(size)])


def pad_right(values: Column, size: int) -> Column:
    """Cut to ``size`` elements or fill up with zeros on the right."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), size)), 1, size)


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def max_abs_difference(left: Column, right: Column) -> Column:
    return F.array_max(F.zip_with(left, right, lambda a, b: F.abs(a - b)))


def grid_readout(tokens: Column, times: int, bands: int, width: int) -> Column:
    """Flat ``[time, band, dim]`` tokens to means then population deviations over the bands.

    The whole computation stays inside the row: no explode and no shuffle.
    """
    cells = F.sequence(F.lit(0), F.lit(times * width - 1))
    steps = F.sequence(F.lit(0), F.lit(bands - 1))

    def band_values(cell: Column) -> Column:
        base = F.floor(cell / width).cast("int") * (bands * width) + cell % width
        return F.transform(steps, lambda m: F.get(tokens, base + m * width))

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(bands))

    moments = F.transform(cells, lambda c: F.struct(band_values(c).alias("v")))
    moments = F.transform(moments, lambda s: F.struct(s["v"].alias("v"), mean(s["v"]).alias("m")))
    deviations = F.transform(
        moments,
        lambda s: F.sqrt(F.aggregate(s["v"], F.lit(0.0), lambda acc, v: acc + (v - s["m"]) * (v - s["m"]))
                         / F.lit(float(bands))))
    return F.concat(F.transform(moments, lambda s: s["m"]), deviations)
