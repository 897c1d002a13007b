"""Selecting points: flag split, systematic sampling, column statistics, sort key and order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.functions.points import columns_of, validate
from epsforest.operators.ranking import global_rank


def split(points: DataFrame, sample_every: int = 1, flag: str | None = None, order: str = "event_id") -> DataFrame:
    """Adds ``is_leftover``: rows whose flag is 0, and of the others those whose rank is no multiple of ``sample_every``.

    Flagged-out rows do not advance the rank. Without sampling there is no shuffle.
    """
    if sample_every < 1:
        raise ValueError("sample_every must be at least 1")
    eligible = F.lit(True) if flag is None else F.coalesce(F.col(flag) != 0, F.lit(False))
    if sample_every == 1:
        out = points.withColumn("is_leftover", ~eligible)
    else:
        ranked = global_rank(points.where(eligible), [order], "_rank")
        out = ranked.withColumn("is_leftover", F.col("_rank") % sample_every != 0).drop("_rank")
        if flag is not None:
            out = out.unionByName(points.where(~eligible).withColumn("is_leftover", F.lit(True)))
    return out.drop(flag) if flag else out


def column_stats(points: DataFrame) -> DataFrame:
    """col, n, total, mean (truncated), score (exact sum of squared deviations from that mean): one aggregation."""
    cols = columns_of(points)
    aggs = [F.count("*").alias("n")]
    for c in cols:
        v = F.col(c).cast("long")
        aggs += [F.sum(v).alias(f"s_{c}"), F.sum(v * v).alias(f"q_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("col"), F.col("n"), F.col(f"s_{c}").alias("total"), F.col(f"q_{c}").alias("squares"), F.col(f"lo_{c}").alias("least"), F.col(f"hi_{c}").alias("most")) for k, c in enumerate(cols))))
    x = points.agg(*aggs).where("n > 0").select(rows.alias("r")).select("r.*")
    x = x.withColumn("mean", F.expr("total div n"))
    score = F.col("squares") - 2 * F.col("mean") * F.col("total") + F.col("n") * F.col("mean") * F.col("mean")
    return x.select("col", "n", "total", "mean", score.alias("score"), F.sqrt(score / F.col("n")).alias("stdev"), "least", "most")


def sort_key(stats: DataFrame) -> DataFrame:
    """sort_key, second_key: the column of the largest score, the lowest of equal ones; and the one that breaks ties."""
    best = stats.agg(F.max(F.struct("score", (-F.col("col")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("sort_key")).where("sort_key is not null")
    return best.withColumn("second_key", F.when(F.col("sort_key") == 0, 1).otherwise(F.col("sort_key") - 1))


def sorted_points(points: DataFrame, key: int, order: str = "event_id") -> DataFrame:
    """Adds ``sorted_rank``: the place in the stable order by key, second key and input order."""
    cols = columns_of(points)
    second = 1 if key == 0 else key - 1
    by = [cols[key], *([cols[second]] if second < len(cols) else []), order]
    return global_rank(points, by, "sorted_rank")


def key_histogram(points: DataFrame, key: int) -> DataFrame:
    """value, n of the key column."""
    return points.groupBy(F.col(columns_of(points)[key]).alias("value")).agg(F.count("*").alias("n"))


@dataclass
class Selection:
    """What select() returns: retained points, the leftover ones (None without flag and sampling), and on demand the key column and counts."""

    points: DataFrame
    leftover: DataFrame | None
    given_key: int | None = None

    @cached_property
    def key(self) -> int:
        """The sort key: as given, or the column of the largest score; one aggregation, when it is first asked for."""
        if self.given_key is not None:
            return self.given_key
        found = sort_key(column_stats(self.points)).first()
        if found is None:
            raise ValueError("no row is retained")
        return found["sort_key"]

    def counts(self) -> DataFrame:
        """One row: how many are selected, and how many are left over."""
        left = self.points.limit(0).select("event_id") if self.leftover is None else self.leftover.select("event_id")
        both = self.points.select(F.lit(1).alias("kept")).unionAll(left.select(F.lit(0).alias("kept")))
        return both.agg(F.count_if(F.col("kept") == 1).alias("selected"), F.count_if(F.col("kept") == 0).alias("leftover"))


def select(points: DataFrame, sample_every: int = 1, flag: str | None = None, key: int | None = None, check: bool = True, order: str = "event_id") -> Selection:
    """Splits and validates the retained rows only. order: the column whose order sampling counts in, ``position`` for that of the input."""
    parts = split(points, sample_every, flag, order)
    kept = parts.where(~F.col("is_leftover")).drop("is_leftover")
    kept = validate(kept) if check else kept
    left = parts.where("is_leftover").drop("is_leftover") if sample_every > 1 or flag else None
    return Selection(kept, left, key)
