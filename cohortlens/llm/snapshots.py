"""Collapse of cumulative conversation logs and rendering of what remains.

A logger that stores a conversation after every turn leaves prefixes of one conversation behind.
Rolling hashes over the turns, one running sum per conversation, identify every prefix; a conversation
whose whole hash is a proper prefix of another goes (anti-join), equal ones leave the one with the
smallest id.  Only the remaining, maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storing import settled


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; null and empty differ."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("r"), role), F.lit("n")), F.lit("\x1f"),
                          F.coalesce(F.concat(F.lit("t"), text), F.lit("n"))))


def segment(role: Column, text: Column) -> Column:
    """A turn as chat text.  Markers inside roles and texts are broken up, so that a text cannot open a turn."""
    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), plain(F.coalesce(role, F.lit("unknown"))), F.lit("|>\n"), plain(F.coalesce(text, F.lit(""))), F.lit("\n"))


def maximal(turns: DataFrame) -> DataFrame:
    """(``conv``, ``n_turns``, ``n_copies``) of the maximal conversations of ``turns`` (conv, turn, digest; distinct rows)."""
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select("conv", "turn", "digest", F.row_number().over(order).alias("pos"),
                          F.lead(F.lit(True)).over(order).isNull().alias("last"))
    # Sums of hashes of (position, turn): equal for equal prefixes, two of 64 bits each.
    rolled = placed.select("conv", "pos", "last", *[
        F.sum(F.xxhash64("pos", "digest", F.lit(salt)).cast("decimal(20,0)")).over(upto).alias(f"p{salt}") for salt in (0, 1)])
    rolled = settled(rolled, "turn-prefixes")
    key = ["pos", "p0", "p1"]
    whole = rolled.filter("last").groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    proper = rolled.filter("not last").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render_maximal(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(``conv_col``, ``n_turns``, ``n_copies``, ``rendered``), one row per maximal conversation.

    Turns are ordered by ``turn_col`` (null first) and, where it repeats, by the digest of role and text.  Rows that repeat a
    whole turn of a conversation count once.  A null role is "unknown" and a null text empty when rendered, but
    null and empty are different turns.  Rows without conversation id belong to no conversation.  ``n_copies``
    counts the conversations equal to the one that stays.  An empty table gives an empty result; other
    columns are not read.  A rendered conversation is one value, so it must fit a row, as a document does.
    """
    turns = (df.filter(F.col(conv_col).isNotNull())
             .select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("said"),
                     turn_digest(F.col(role_col), F.col(text_col)).alias("digest")))
    kept = maximal(turns.select("conv", "turn", "digest").distinct())
    text = turns.select("conv", F.struct("turn", "digest", segment(F.col("role"), F.col("said")).alias("line")).alias("t"))
    rendered = (text.join(kept, "conv").groupBy("conv", "n_turns", "n_copies")
                .agg(F.array_join(F.transform(F.sort_array(F.collect_set("t")), lambda t: t["line"]), "").alias("rendered")))
    return rendered.select(F.col("conv").alias(conv_col), "n_turns", "n_copies", F.concat("rendered", F.lit("<|end|>")).alias("rendered"))
