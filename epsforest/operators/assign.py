"""Nearest-cluster assignment of what a scan left over."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epsforest.functions.points import columns_of
from epsforest.operators import space
from epsforest.operators.scan import Scan
from epsforest.runtime import cut

#: Rows of a block of queries or targets, and queries that are compared with a block of targets at a time.
ROWS, CHUNK = 1024, 128


def settled(best: DataFrame) -> DataFrame:
    """event_id, d2, cluster of (event_id, cluster, d2): the cluster at the least distance; 0 if it is not the only one."""
    low, high = (F.min(F.struct("d2", c.alias("c"))).alias(n) for n, c in (("low", F.col("cluster")), ("high", -F.col("cluster"))))
    m = best.groupBy("event_id").agg(low, high)
    return m.select("event_id", F.col("low.d2").alias("d2"), F.when(F.col("low.c") == -F.col("high.c"), F.col("low.c")).otherwise(0).cast("int").alias("cluster"))


def _met(cols: list[str], cutoff: int | None):
    """event_id, d2, low, high of one group: each query's least distance to the block's targets and the ends of the clusters there."""

    def run(_, queries: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or targets.empty:
            return pd.DataFrame({c: [] for c in ("event_id", "d2", "low", "high")}).astype("int64")
        x, y, cluster = space.frame(queries, cols), space.frame(targets, [f"t_{c}" for c in cols]), targets["cluster"].to_numpy(np.int64)
        norms, most = (y * y).sum(axis=1), np.iinfo(np.int64).max
        out = []
        for lo in range(0, len(x), CHUNK):
            part = x[lo : lo + CHUNK]
            # whole numbers far below 2**53, so products of floats are exact
            d = (part * part).sum(axis=1)[:, None] + norms[None] - 2 * (part @ y.T)
            least = d.min(axis=1)
            at = d == least[:, None]
            out.append((least, np.where(at, cluster[None], most).min(axis=1), np.where(at, cluster[None], -1).max(axis=1)))
        least, low, high = (np.concatenate(o) for o in zip(*out, strict=True))
        keep = least <= (np.inf if cutoff is None else cutoff)
        return pd.DataFrame({"event_id": queries["event_id"].to_numpy()[keep], "d2": least[keep].astype(np.int64), "low": low[keep], "high": high[keep]})

    return run


def _both(queries: DataFrame, targets: DataFrame, rows: int) -> space.Blocks:
    """Queries and targets in common blocks, with bounds for each: ``asks`` tells them apart."""
    cols = columns_of(queries)
    # equal vectors of one cluster are one target
    targets = targets.groupBy(*cols, "cluster").agg(F.min("event_id").alias("event_id"))
    both = queries.select("event_id", *cols, F.lit(None).cast("int").alias("cluster"), F.lit(True).alias("asks"))
    both = both.unionByName(targets.select("event_id", *cols, F.col("cluster").cast("int").alias("cluster"), F.lit(False).alias("asks")))
    return space.lay(both, rows=rows, side="asks")


def near_pairs(laid: space.Blocks, cutoff: int | None, fan: int = space.FAN, direct: int = space.DIRECT) -> DataFrame:
    """(i, j): for the queries of each block the blocks whose targets may hold the nearest one of some query.

    At every level of the tree, the least of the largest distances to nodes of targets bounds how far the nearest target of any query of
    a node is; nodes that are farther away, or beyond the cutoff, are left behind.
    """
    near, far = space.nearest(laid.columns, laid.pivots), space.farthest_apart(laid.columns, laid.pivots)

    def keep(pairs: DataFrame) -> DataFrame:
        x = pairs.withColumns({"_near": near, "_far": far}).withColumn("_most", F.min("_far").over(Window.partitionBy("i")))
        most = F.col("_most") if cutoff is None else F.least("_most", F.lit(cutoff))
        return x.where(F.col("_near") <= most).drop("_near", "_far", "_most")

    left, right = laid.bounds.where("asks"), laid.bounds.where("not asks")
    return space.descend(left, right, (laid.count, laid.count), laid.columns + laid.pivots, keep, fan=fan, direct=direct).select("i", "j")


def nearest(queries: DataFrame, targets: DataFrame, cutoff: int | None = None, rows: int = ROWS, fan: int = space.FAN, direct: int = space.DIRECT) -> DataFrame:
    """event_id, d2, cluster: the cluster of the nearest target; 0 if several clusters have one at that distance.

    queries: (event_id, c*); targets: (event_id, c*, cluster). Without a target, or none within ``cutoff`` (a squared distance), a query
    has no row. Queries and targets are dealt to blocks of near rows; bounds of the blocks decide which meet, in one round and as groups of
    at most ``rows`` of each.
    """
    cols = columns_of(queries)
    laid = _both(queries, targets, rows)
    if not laid.count:
        return queries.select("event_id", F.lit(0).cast("long").alias("d2"), F.lit(0).alias("cluster")).limit(0)
    pairs = near_pairs(laid, cutoff, fan, direct)
    pairs = cut(pairs, "pairs") if laid.count > direct else pairs
    asked = laid.rows.where("asks").select("event_id", *cols, F.col("block").alias("i")).join(pairs, "i")
    held = laid.rows.where("not asks").select("cluster", *(F.col(c).alias(f"t_{c}") for c in cols), F.col("block").alias("j")).join(pairs, "j").withColumnsRenamed({"i": "ti", "j": "tj"})
    met = asked.groupBy("i", "j").cogroup(held.groupBy("ti", "tj")).applyInPandas(_met(cols, cutoff), "event_id long, d2 long, low long, high long")
    ends = [F.min(F.struct("d2", "low")).alias("a"), F.min(F.struct("d2", (-F.col("high")).alias("minus"))).alias("b")]
    best = met.groupBy("event_id").agg(*ends).select("event_id", "a.d2", "a.low", (-F.col("b.minus")).alias("high"))
    return best.select("event_id", "d2", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0).cast("int").alias("cluster"))


def assign_unassigned(result: Scan, labels: DataFrame) -> DataFrame:
    """event_id, cluster: ``labels`` with every unassigned event that the last pass had in some component given its nearest cluster."""
    cols = columns_of(result.points)
    alive = result.last_labels().select("event_id", F.lit(True).alias("_alive"))
    events = cut(result.points.join(labels, "event_id").join(alive, "event_id", "left").select("event_id", *cols, "cluster", "_alive"), "labelled")
    found = nearest(events.where("cluster = 0 and _alive"), events.where("cluster > 0"))
    new = found.select("event_id", F.col("cluster").alias("_c"))
    return events.select("event_id", "cluster").join(new, "event_id", "left").select("event_id", F.when(F.col("cluster") == 0, F.coalesce("_c", F.lit(0))).otherwise(F.col("cluster")).alias("cluster"))


def assign_leftover(result: Scan, labels: DataFrame, leftover: DataFrame) -> DataFrame:
    """event_id, cluster of held-out events: their nearest cluster within the scan's end distance plus one step, else 0."""
    cols = columns_of(result.points)
    targets = result.points.join(labels.where("cluster > 0"), "event_id")
    cutoff = result.schedule.leftover_threshold(len(cols))
    found = nearest(leftover.select("event_id", *cols), targets, cutoff)
    new = found.select(F.col("event_id").alias("_e"), F.col("cluster").alias("_c"))
    return leftover.join(new, leftover["event_id"] == F.col("_e"), "left").select("event_id", F.coalesce("_c", F.lit(0)).alias("cluster"))
