"""A space-partition tree: points in blocks of near points with bounds, and the pairs of blocks that may hold near points.

Points are ranked along a curve (the interleaved bits of their cells; for many columns their nearest pivot and the distance to
it) and cut to blocks of equal size, so no block is hot. A node of the tree is a run of FAN nodes one level below;
its bounds are the ends of its coordinates and of its distances to the pivots, from which the least and the largest
distance of two nodes follow. Pairs of nodes are followed from the top down, and whatever is too far apart is left behind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsforest.functions.points import columns_of
from epsforest.operators.ranking import global_rank
from epsforest.runtime import cut

#: Rows of a block; children of a node; so many nodes on each side are paired without a tree above them.
BLOCK, FAN, DIRECT = 4096, 8, 64
#: More columns than this are bounded by their distances to pivots, too: farthest points of a bounded sample.
NARROW, PIVOTS, SAMPLE = 16, 8, 2048
#: Bits of a place on the curve.
BITS = 62


@dataclass
class Blocks:
    """``rows``: the points with ``block``, ``place`` on the curve and their distances ``p*`` to pivots; ``bounds``: a row a block."""

    rows: DataFrame
    #: None for a single block.
    bounds: DataFrame | None
    count: int
    columns: list[str]
    pivots: list[str]
    #: Whether equal places are equal cells, all of whose points are within the floor of each other.
    celled: bool
    #: Rows of a block, and of the last one.
    rows_each: int = 0
    rows_last: int = 0


def curve(columns: list[str], lows: list[int], highs: list[int], width: int) -> tuple[Column, bool]:
    """The interleaved bits of the cells of ``width``, and whether all bits of the cells fit."""
    bits = [max(0, (hi - lo) // width).bit_length() for lo, hi in zip(lows, highs, strict=True)]
    less = 0
    while sum(max(0, b - less) for b in bits) > BITS:
        less += 1
    place, at = [], 0
    for bit in range(max([0, *bits])):
        for c, lo, b in zip(columns, lows, bits, strict=True):
            if bit >= less and bit < b:
                place.append(f"shiftleft(shiftright((cast({c} as bigint) - {lo}) div {width}, {bit}) & 1L, {at})")
                at += 1
    return F.expr(" + ".join(place) or "0L").cast("long"), less == 0


def farthest(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those chosen before."""
    chosen, near = [0], np.full(len(sample), np.inf)
    for _ in range(min(most, len(sample)) - 1):
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    return sample[chosen]


def _to_pivots(points: DataFrame, cols: list[str], pivots: np.ndarray) -> DataFrame:
    """Adds each row's whole distances to the pivots, rounded down, and their nearest pivot: ``p*`` and ``cell``."""
    names = [f"p{k}" for k in range(len(pivots))]

    def run(batches):
        for x in batches:
            v = x[cols].to_numpy(np.float64)
            d = np.sqrt(np.maximum(0, (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * v @ pivots.T))
            x = x.assign(**{n: np.floor(d[:, k]).astype(np.int64) for k, n in enumerate(names)})
            yield x.assign(cell=d.argmin(axis=1).astype(np.int32))

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in points.schema), *(f"{n} long" for n in names), "cell int"])
    return points.mapInPandas(run, schema)


def chosen_pivots(points: DataFrame) -> np.ndarray:
    """Pivots of points with many columns, from a sample of a fixed number of rows by their hash; none for few columns."""
    cols = columns_of(points)
    if len(cols) <= NARROW:
        return np.zeros((0, len(cols)))
    sample = points.orderBy(F.xxhash64(*cols), "event_id").select(*cols).limit(SAMPLE).toPandas().to_numpy(np.float64)
    return farthest(sample) if len(sample) else sample


def ends_of(points: DataFrame) -> list[Column]:
    """Aggregates that ``lay`` needs of all points."""
    return [F.coalesce(f(c), F.lit(0)).alias(f"{n}{c}") for c in columns_of(points) for n, f in (("lo", F.min), ("hi", F.max))]


def lay(points: DataFrame, floor: int = 0, rows: int = BLOCK, pivots: np.ndarray | None = None, facts: dict | None = None, side: str | None = None) -> Blocks:
    """Points (event_id, c*, ..) in blocks of ``rows`` rows, up to twice as many in a single one.

    Cells are as wide as all their points stay within ``floor`` (a squared distance) of each other. facts: the number of points ``n`` and
    what ``ends_of`` finds, if known. side: a column; bounds are given whatever the number of rows, for each of its values in a block.
    """
    cols = columns_of(points)
    ends = facts or points.agg(F.count("*").alias("n"), *ends_of(points)).first()
    single = ends["n"] <= 2 * rows and not side
    if single:
        pivots = np.zeros((0, len(cols)))
    pivots = chosen_pivots(points) if pivots is None else pivots
    names = [f"p{k}" for k in range(len(pivots))]
    if names:
        placed, celled = _to_pivots(points, cols, pivots), False
        placed = placed.withColumn("place", F.col("cell").cast("long") * (1 << 40) + F.element_at(F.array(*names), F.col("cell") + 1)).drop("cell")
    else:
        place, celled = curve(cols, [ends[f"lo{c}"] for c in cols], [ends[f"hi{c}"] for c in cols], isqrt(floor // len(cols)) + 1)
        placed = points.withColumn("place", place)
    if single:
        return Blocks(placed.withColumn("block", F.lit(0)), None, 1, cols, names, celled)
    ranked = global_rank(placed, ["place", "event_id"], "rank").withColumn("block", F.expr(f"cast(rank div {rows} as int)"))
    bounds = ranked.groupBy("block", *([side] if side else [])).agg(*_ends(cols + names), F.min("place").alias("first"), F.max("place").alias("last"), F.min_by("event_id", "rank").alias("head"), F.max_by("event_id", "rank").alias("tail"))
    count = ceil(ends["n"] / rows)
    return Blocks(ranked.drop("rank"), cut(bounds, "bounds"), count, cols, names, celled, rows, ends["n"] - rows * (count - 1))


def coarser(laid: Blocks, by: int) -> Blocks:
    """The same points in blocks that hold ``by`` of laid's blocks each; rows keep theirs as ``part``."""
    count, n = ceil(laid.count / by), laid.rows_each * (laid.count - 1) + laid.rows_last
    bounds = laid.bounds if by == 1 else cut(_raised(laid.bounds, laid.columns + laid.pivots, by, []), "bounds")
    rows = laid.rows.withColumn("part", F.col("block")).withColumn("block", F.expr(f"cast(block div {by} as int)"))
    return replace(laid, rows=rows, bounds=bounds, count=count, rows_each=laid.rows_each * by, rows_last=n - laid.rows_each * by * (count - 1))


def cost(laid: Blocks) -> Column:
    """How many pairs of rows a pair (i, j) of blocks has."""
    size = lambda k: F.when(F.col(k) == laid.count - 1, laid.rows_last).otherwise(laid.rows_each).cast("long")
    return F.when(F.col("i") == F.col("j"), size("i") * (size("i") - 1) / 2).otherwise(size("i") * size("j")).cast("long")


def _ends(names: list[str]) -> list[Column]:
    return [f(c).cast("long").alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]


def _raised(bounds: DataFrame, names: list[str], by: int, extra: list[Column]) -> DataFrame:
    """Bounds of the nodes that each hold ``by`` blocks."""
    if by == 1:
        return bounds
    again = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]
    return bounds.groupBy(F.expr(f"cast(block div {by} as int)").alias("block")).agg(*again, *extra)


def _gap(c: str) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.col(f"j_lo_{c}") - F.col(f"i_hi_{c}"), F.col(f"i_lo_{c}") - F.col(f"j_hi_{c}"))


def _span(c: str) -> Column:
    return F.greatest(F.col(f"j_hi_{c}") - F.col(f"i_lo_{c}"), F.col(f"i_hi_{c}") - F.col(f"j_lo_{c}"))


def nearest(cols: list[str], pivots: list[str]) -> Column:
    """The least squared distance of points of nodes i and j."""
    box = reduce(lambda a, b: a + b, (_gap(c) * _gap(c) for c in cols))
    # distances to pivots are rounded down, so two of them may be nearer by less than one
    by_pivot = [F.greatest(F.lit(0).cast("long"), _gap(p) - 1) for p in pivots]
    return F.greatest(box, *(g * g for g in by_pivot)) if pivots else box


def farthest_apart(cols: list[str], pivots: list[str]) -> Column:
    """The largest squared distance of points of nodes i and j."""
    box = reduce(lambda a, b: a + b, (_span(c) * _span(c) for c in cols))
    sums = [F.col(f"i_hi_{p}") + F.col(f"j_hi_{p}") + 2 for p in pivots]
    return F.least(box, *(s * s for s in sums)) if pivots else box


def descend(
    left: DataFrame, right: DataFrame, counts: tuple[int, int], names: list[str], keep: Callable[[DataFrame], DataFrame], extra: list[Column] | None = None, carry: list[str] | None = None, fan: int = FAN, direct: int = DIRECT
) -> DataFrame:
    """Pairs (i, j) of blocks with their bounds ``i_*``, ``j_*``, of those that ``keep`` leaves at every level of both trees.

    keep: takes pairs of nodes with bounds and returns those that may hold what is looked for. extra: further
    aggregates of a node's blocks, ``carry`` their names.
    """
    spark, by = left.sparkSession, 1
    while max(counts) > direct * by:
        by *= fan
    top = [ceil(n / by) for n in counts]
    pairs = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(top[0] - 1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(top[1] - 1))))
    while True:
        a, b = (_raised(x, names, by, extra or []) for x in (left, right))
        wanted = ["block", *(f"{n}_{c}" for c in names for n in ("lo", "hi")), *(carry or [])]
        a, b = (x.select(*(F.col(c).alias(s if c == "block" else f"{s}_{c}") for c in wanted)) for x, s in ((a, "i"), (b, "j")))
        pairs = keep(pairs.join(a, "i").join(b, "j"))
        if by == 1:
            return pairs
        by //= fan
        last = [ceil(n / by) - 1 for n in counts]
        down = lambda k, end: F.explode(F.sequence(F.col(k) * fan, F.least(F.col(k) * fan + (fan - 1), F.lit(end)))).alias(k)
        pairs = pairs.select(down("i", last[0]), "j").select("i", down("j", last[1]))


def frame(x: pd.DataFrame, cols: list[str]) -> np.ndarray:
    return np.ascontiguousarray(x[cols].to_numpy(np.float64))
