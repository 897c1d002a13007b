"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.operators.skew import split_join
from epsforest.runtime import cut

#: Up to so many edges a key can't hold more than a task takes.
FEW = 100_000


def _mark(df: DataFrame) -> tuple:
    """A fingerprint of a set of star edges, one small row on the driver."""
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with ``m``, the least v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if total <= FEW:
        return edges.join(least.drop("n"), "u")
    least = cut(least, "least")
    return split_join(edges, least.drop("n"), ["u"], least.select("u", "n"), total)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, comp)`` for every node of ``edges``; ``comp`` is the smallest id of its component.

    Each round is two aggregations and two equi-joins on node ids. A hot node's rows are pre-aggregated for the minimum
    and their number, and its side of the join is dealt to several tasks. Rounds grow with the logarithm of the longest
    path. Rows with a null end and self-loops are ignored. An empty input gives an empty result.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(hi.alias("u"), lo.alias("v")).distinct(), "cc")
    seen = _mark(e)
    while seen[0]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(sym, 2 * seen[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.distinct()
        if seen[0] > FEW:
            large = cut(large, "cc")
        rest = _with_least(large, 2 * seen[0])
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        rest = rest.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(rest.unionByName(least).distinct(), "cc")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots.select("id", F.col("id").alias("comp")))
