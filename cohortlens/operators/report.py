"""Display form of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_decimals


def display_projection(table: DataFrame, columns: Sequence[str], decimals: Mapping[str, int],
                       integers: Sequence[str] = (), labels: Mapping[str, str] | None = None,
                       headers: Mapping[str, str] | None = None) -> DataFrame:
    """Chosen columns as display text: fixed decimals, whole numbers, and mapped value labels."""
    names = F.create_map(*[F.lit(x) for pair in (labels or {}).items() for x in pair]) if labels else None

    def shown(column: str) -> Column:
        c = F.col(column)
        if column in integers:
            return c.cast("long").cast("string")
        if column in decimals:
            return fixed_decimals(c.cast("double"), decimals[column])
        text = c.cast("string")
        return text if names is None else F.coalesce(F.try_element_at(names, text), text)

    return table.select(*[shown(c).alias((headers or {}).get(c, c)) for c in columns])
