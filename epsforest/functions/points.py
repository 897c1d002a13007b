"""Point tables: ``event_id`` and integer columns ``c0 .. c{D-1}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The range of a feature.
LEAST, MOST = 0, 16383


def columns_of(points: DataFrame) -> list[str]:
    """The feature columns in order."""
    found = [c for c in points.columns if c[:1] == "c" and c[1:].isdigit()]
    return sorted(found, key=lambda c: int(c[1:]))


def points(df: DataFrame, event_id: str | Column, features: list[str | Column]) -> DataFrame:
    """A point table from an id and feature expressions; values are floored to integers."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(event_id).cast("long").alias("event_id"), *(F.floor(as_col(c)).cast("int").alias(f"c{k}") for k, c in enumerate(features)))


def vector_points(df: DataFrame, event_id: str, vector: Column, size: int) -> DataFrame:
    """A point table from an array column."""
    v = df.select(F.col(event_id).cast("long").alias("event_id"), vector.alias("v"))
    return v.select("event_id", *(F.get("v", k).cast("int").alias(f"c{k}") for k in range(size)))


def rescale(df: DataFrame, columns: list[str], most: int = MOST) -> DataFrame:
    """Maps each column's range onto 0..most, truncating; a constant column becomes 0. One aggregation."""
    bounds = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()
    out = {}
    for c in columns:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        out[c] = F.floor((F.col(c) - lo) * most / (hi - lo)).cast("int") if lo is not None and hi > lo else F.lit(0)
    return df.withColumns(out)


def out_of_range(points: DataFrame) -> DataFrame:
    """The rows that validation refuses: a missing value or one outside the range."""
    bad = F.lit(False)
    for c in columns_of(points):
        bad = bad | F.col(c).isNull() | ~F.col(c).between(LEAST, MOST)
    return points.where(bad | F.col("event_id").isNull())


def validate(points: DataFrame) -> DataFrame:
    """Fails the job at the first bad row, inside the same pass over the data."""
    ok = F.col("event_id").isNotNull()
    for c in columns_of(points):
        ok = ok & F.col(c).isNotNull() & F.col(c).between(LEAST, MOST)
    checked = F.when(ok, F.col("event_id")).otherwise(F.raise_error(F.concat(F.lit("rescale your data first: bad event "), F.coalesce(F.col("event_id").cast("string"), F.lit("null")))))
    return points.withColumn("event_id", checked.cast("long"))


def squared_distance(a: str, b: str, columns: list[str]) -> Column:
    """An explicit sum in long arithmetic, so that it stays in generated code."""
    total = None
    for c in columns:
        d = F.col(f"{a}{c}").cast("long") - F.col(f"{b}{c}").cast("long")
        total = d * d if total is None else total + d * d
    return total
