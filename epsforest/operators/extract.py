"""What one does with labelled events: extraction, summaries, the final union, clustering again."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epsforest.functions.points import columns_of
from epsforest.functions.schedule import threshold
from epsforest.operators.scan import Scan, scan
from epsforest.runtime import cut


def extract(points: DataFrame, labels: DataFrame, cluster: int | None = None, with_label: bool = True) -> DataFrame:
    """Assigned events with their features, of one cluster or of all; without the label only for one cluster."""
    if not with_label and cluster is None:
        raise ValueError("the label can only be left out for one cluster")
    wanted = labels.where("cluster > 0" if cluster is None else F.col("cluster") == cluster)
    out = points.join(wanted, "event_id").select("event_id", *columns_of(points), "cluster")
    return out if with_label else out.drop("cluster")


def sub_extract(points: DataFrame, labels: DataFrame, cluster: int) -> DataFrame:
    """One cluster on its own, renumbered 1."""
    return extract(points, labels, cluster).withColumn("cluster", F.lit(1))


def with_assignment(points: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled events with features, cluster and whether they have one; written by ``assigned``, one pass fills both outputs."""
    return points.join(labels, "event_id").select("event_id", *columns_of(points), "cluster", (F.col("cluster") > 0).alias("assigned"))


def unassigned(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Events without a cluster, with cluster 0."""
    return points.join(labels.where("cluster = 0"), "event_id").select("event_id", *columns_of(points), "cluster")


def max_cluster(labels: DataFrame) -> DataFrame:
    return labels.agg(F.coalesce(F.max("cluster"), F.lit(0)).alias("max_cluster"))


def summary(labels: DataFrame, category: str | None = None) -> DataFrame:
    """Events per cluster, or per category and cluster."""
    by = ([category] if category else []) + ["cluster"]
    return labels.groupBy(*by).agg(F.count("*").alias("events"))


def summary_table(labels: DataFrame, category: str, clusters: int) -> DataFrame:
    """A row per category, a column ``cluster_k`` per cluster 0 to ``clusters``, with the number of events; null is a category."""
    counts = (F.count_if(F.col("cluster") == k).alias(f"cluster_{k}") for k in range(clusters + 1))
    return labels.groupBy(category).agg(*counts)


def final_union(labels: DataFrame, leftover: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """event_id, cluster of all events, held-out ones included, in the order of their ids."""
    out = labels.select("event_id", "cluster")
    if leftover is not None:
        out = out.unionByName(leftover.select("event_id", "cluster"))
    return out.orderBy("event_id") if ordered else out


def recluster(result: Scan, labels: DataFrame, scope: str = "unassigned", **options) -> dict[int, Scan]:
    """Scans again: the unassigned events as one table (key 0), or each cluster's events on their own.

    Events are joined with their clusters once and laid out by cluster; each scan reads its own part.
    """
    if scope == "unassigned":
        chosen = [0]
    elif scope == "clusters":
        chosen = [r["cluster"] for r in labels.where("cluster > 0").select("cluster").distinct().orderBy("cluster").collect()]
    else:
        raise ValueError("scope is 'unassigned' or 'clusters'")
    wanted = labels.where("cluster = 0" if scope == "unassigned" else "cluster > 0").select("event_id", "cluster")
    members = cut(result.points.join(wanted, "event_id"), "members", by=["cluster"])
    return {c: scan(members.where(F.col("cluster") == c).drop("cluster"), **options) for c in chosen}


def recluster_together(result: Scan, labels: DataFrame, first: float, last: float | None = None, step: float = 0.5, *, min_events: int, **options) -> DataFrame:
    """parent, event_id, cluster: every cluster's events clustered again, all clusters in one scan; numbered inside the parent.

    A further column holds the clusters farther apart than any threshold, so that no pair crosses them and inside them
    distances are what they were. One schedule serves all clusters: its stop rules see all events together, and the
    minimum is a number of events. ``recluster`` scans cluster by cluster, each by a schedule of its own.
    """
    cols = columns_of(result.points)
    apart = math.isqrt(max(threshold(d, len(cols)) for d in (first, first if last is None else last))) + 1
    member = result.points.join(labels.where("cluster > 0").select("event_id", F.col("cluster").alias("parent")), "event_id")
    member = cut(member, "members")
    again = scan(member.select("event_id", *cols, (F.col("parent") * apart).alias(f"c{1 + int(cols[-1][1:])}")), first, last, step, min_events=min_events, dimensions=len(cols), **options)
    found = cut(again.final_labels().join(member.select("event_id", "parent"), "event_id"), "again")
    # a row a cluster
    number = found.where("cluster > 0").select("parent", "cluster").distinct().withColumn("number", F.row_number().over(Window.partitionBy("parent").orderBy("cluster")))
    out = found.join(number.drop("parent"), "cluster", "left")
    return out.select("parent", "event_id", F.coalesce("number", F.lit(0)).alias("cluster"))


def reclustered(spark: SparkSession, scans: dict[int, Scan]) -> DataFrame:
    """parent, event_id, cluster of all scans that ``recluster`` made; clusters are numbered inside their parent. No row without scans."""
    parts = [s.final_labels().select(F.lit(c).alias("parent"), "event_id", "cluster") for c, s in scans.items()]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "parent int, event_id long, cluster int"))
