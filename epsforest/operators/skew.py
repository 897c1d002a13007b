"""Equi-joins whose left side may hold a few keys very often: such keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.runtime import cut

#: Rows of one key that a task gets at least before the key is split; keys that are split at most (their table is broadcast).
ROWS, HOT = 1024, 100_000


def hot_keys(counts: DataFrame, on: list[str], total: int, rows: int = ROWS) -> DataFrame | None:
    """(on.., _salts): the keys of ``counts`` (on.., n) with more than ``max(rows, total / HOT)`` rows, and into how many parts they go.

    total: the sum of n, or more. So many rows a key leave room for at most HOT keys: the table is small whatever the data. None where no key can have so many.
    """
    limit = max(rows, -(-total // HOT))
    if total <= limit:
        return None
    return cut(counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_salts")), "hot")


def salted(left: DataFrame, on: list[str], hot: DataFrame | None, by: list[str] | None = None) -> DataFrame:
    """left with ``_salt``: 0, or for a hot key a part by the hash of ``by`` (all columns)."""
    if hot is None:
        return left.withColumn("_salt", F.lit(0))
    part = F.pmod(F.xxhash64(*(by or left.columns)), F.col("_salts")).cast("int")
    return left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(part, F.lit(0))).drop("_salts")


def copied(right: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """right with a row for each ``_salt`` of its key."""
    if hot is None:
        return right.withColumn("_salt", F.lit(0))
    return right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def split_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, total: int, rows: int = ROWS) -> DataFrame:
    """The inner join of ``left`` and ``right`` on ``on``. counts: (on.., n) of left's rows a key, total: of all.

    No task gets much more than ``max(rows, total / HOT)`` rows of one key of left; right should have few rows a key. Rows
    with a null in a key have no partner.
    """
    hot = hot_keys(counts, on, total, rows)
    if hot is None:
        return left.join(right, on)
    return salted(left, on, hot).join(copied(right, on, hot), [*on, "_salt"]).drop("_salt")
