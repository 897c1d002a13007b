"""Scoring new events as they stream in: each gets the nearest cluster of a finished scan."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epsforest.functions.points import columns_of, squared_distance
from epsforest.operators.assign import settled
from epsforest.operators.neighbors import _cells, grid_columns


def score_stream(events: DataFrame, targets: DataFrame, cutoff: int, watermark: tuple[str, str] | None = None) -> DataFrame:
    """event_id, cluster, d2 of streamed events within ``cutoff`` of a target; a stateless stream-static join on grid cells.

    Used through ``foreachBatch`` or ``writeStream`` in append mode. targets: (event_id, c*, cluster). An event has a row
    for each cluster in reach; ``settle`` picks the nearest of a micro-batch.
    """
    if watermark:
        events = events.withWatermark(*watermark)
    cols, width = columns_of(targets), isqrt(cutoff) + 1
    by = grid_columns(targets, cutoff) or [cols[0]]
    offsets = [[]]
    for _ in by:
        offsets = [[*o, d] for o in offsets for d in (-1, 0, 1)]
    near = F.explode(F.array(*(F.array(*map(F.lit, o)) for o in offsets)))
    static = targets.withColumn("_o", near).select(*(F.col(c).alias(f"r_{c}") for c in (*cols, "cluster")), *_cells(by, width, F.col("_o")))
    stream = events.select(F.col("event_id").alias("l_event_id"), *(F.col(c).alias(f"l_{c}") for c in cols), *_cells(by, width))
    d2 = squared_distance("l_", "r_", cols)
    return stream.join(static, [f"g{k}" for k in range(len(by))]).where(d2 <= cutoff).select(F.col("l_event_id").alias("event_id"), F.col("r_cluster").alias("cluster"), d2.alias("d2"))


def settle(batch: DataFrame) -> DataFrame:
    """event_id, cluster: the nearest; 0 if two clusters are equally near."""
    return settled(batch.select("event_id", "cluster", "d2")).select("event_id", "cluster")


def write_scores(scores: DataFrame, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Starts the stream of settled scores into ``path``, a folder for each micro-batch: one that is done again replaces its own.

    now: takes what is there and ends. Events out of every cluster's reach have no row.
    """
    def save(batch: DataFrame, number: int) -> None:
        settle(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = scores.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer).start()
