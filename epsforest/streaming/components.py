"""Components of a stream of points at one distance: every micro-batch adds the links that its points make.

A point is stored in the state of its own cell and looks into all cells that its reach touches. Cells are ``coarse`` times as
wide as the reach, so most points touch one or few. Of two points the later one finds the earlier one stored, or both come in one batch,
so no link is missed; each cell and batch emits a spanning forest of what it finds, never more rows than points. Components of
all links that were emitted are those of all pairs.

With a ``horizon`` points link only if their times are no farther apart, and time is one more column of the cells: a timer drops a cell's state
once the watermark says that nothing within the horizon can come. Without one, a cell keeps its distinct vectors, an equal
one is linked to the first of them. ``lanes`` deals the points of each cell to several states; every point looks into all of them.

Defined results: a row with a null id, coordinate or time takes no part. Rows that repeat an id are one node. A row later
than the watermark is dropped by Spark. A stream without rows emits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from epsforest.functions.points import columns_of
from epsforest.operators.components import connected_components
from epsforest.operators.forest import forest_of

LINKS = "a long, b long, d2 long"
#: Cells are so many reaches wide; columns that cut cells at most.
COARSE, CUT = 8, 3
#: Points that are compared with a state at a time; links after which a batch's forest is thinned; parts of a state before they are joined.
CHUNK, WAITING, PARTS = 256, 200_000, 32


class Linker(StatefulProcessor):
    """The state of a cell: its own points, a part for each batch that brought some. Rows are (event_id, time, c*) as 64-bit integers."""

    def __init__(self, columns: list[str], t: int, horizon: int | None, bucket: int | None):
        self.names = ["event_id", "time", *columns]
        self.t, self.horizon, self.bucket = t, horizon, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getListState("stored", "points binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        x, own = came[self.names].to_numpy(np.int64), came["own"].to_numpy(bool)
        parts = [np.frombuffer(p[0], np.int64).reshape(-1, len(self.names)) for p in self.stored.get()] if self.stored.exists() else []
        held = np.concatenate(parts) if parts else np.zeros((0, len(self.names)), np.int64)
        # rows equal but for their ids are compared once: the first of them, to which the others are linked
        mine, mine_links = self._distinct(x[own])
        probes, probe_links = self._distinct(x)
        links = self._thin([mine_links, probe_links, *self._near(probes, np.concatenate([held, mine]))])
        if len(mine):
            self._store(mine, held, len(parts))
            if self.horizon is not None and not parts:
                self.handle.registerTimer((int(key[-1]) + 1) * self.bucket + self.horizon + 1)
        yield pd.DataFrame(links, columns=["a", "b", "d2"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        yield pd.DataFrame(np.zeros((0, 3), np.int64), columns=["a", "b", "d2"])

    def close(self) -> None:
        pass

    def _distinct(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(x):
            return x, np.zeros((0, 3), np.int64)
        x = x[np.argsort(x[:, 0], kind="stable")]
        _, first, which = np.unique(x[:, 1:], axis=0, return_index=True, return_inverse=True)
        to = x[first[which.ravel()], 0]
        more = to != x[:, 0]
        return x[np.sort(first)], np.stack([to[more], x[more, 0], np.zeros(more.sum(), np.int64)], axis=1)

    def _store(self, mine: np.ndarray, held: np.ndarray, parts: int) -> None:
        if len(held):  # what is there already needs no second place
            rows = np.ascontiguousarray(np.concatenate([held, mine])[:, 1:])
            _, first = np.unique(rows, axis=0, return_index=True)
            mine = mine[np.sort(first[first >= len(held)]) - len(held)]
        if parts >= PARTS:
            self.stored.put([(np.concatenate([held, mine]).tobytes(),)])
        elif len(mine):
            self.stored.appendValue((mine.tobytes(),))

    def _near(self, probes: np.ndarray, targets: np.ndarray) -> Iterator[np.ndarray]:
        y = targets[:, 2:].astype(np.float64)
        for lo in range(0, len(probes), CHUNK):
            p = probes[lo : lo + CHUNK]
            d2 = np.zeros((len(p), len(y)))
            for c in range(y.shape[1]):
                gap = p[:, c + 2].astype(np.float64)[:, None] - y[:, c][None]
                d2 += gap * gap
            ok = (d2 <= self.t) & (p[:, :1] != targets[:, 0][None])
            if self.horizon is not None:
                ok &= np.abs(p[:, 1][:, None] - targets[:, 1][None]) <= self.horizon
            i, j = np.nonzero(ok)
            a, b = p[i, 0], targets[j, 0]
            yield np.stack([np.minimum(a, b), np.maximum(a, b), d2[i, j].astype(np.int64)], axis=1)

    @staticmethod
    def _thin(found: list[np.ndarray]) -> np.ndarray:
        forest = lambda x: x[forest_of(x[:, 0], x[:, 1], x[:, 2])] if len(x) else x
        held, rest, waiting = np.zeros((0, 3), np.int64), [], 0
        for x in found:
            rest.append(x)
            waiting += len(x)
            if waiting > max(WAITING, len(held)):
                held, rest, waiting = forest(np.concatenate([held, *rest])), [], 0
        return forest(np.concatenate([held, *rest]))


def link_stream(events: DataFrame, t: int, horizon: int | None = None, time: str = "ts", delay: str = "0 seconds", by: list[str] | None = None, coarse: int = COARSE, lanes: int = 1) -> DataFrame:
    """(a, b, d2): links of streamed points (event_id, c*, and with a horizon ``time``) within the squared distance ``t``.

    horizon: milliseconds that linked points may be apart; ``time`` gets a watermark of ``delay``. by: the columns that cut the cells, the
    first three if not given. The state store must be RocksDB's (``with_rocksdb``).
    """
    cols = columns_of(events)
    by = (by or cols)[:CUT]
    if not by:
        raise ValueError("no column to cut")
    reach = isqrt(t)
    if horizon is not None:
        if dict(events.dtypes)[time] == "timestamp_ntz":  # read as UTC, whatever the session's zone
            events = events.withColumn(time, F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', `{time}`)")))
        events = events.withWatermark(time, delay)
    timed = F.unix_millis(time) if horizon is not None else F.lit(0).cast("long")
    whole = events.select(F.col("event_id").cast("long").alias("event_id"), timed.alias("time"), *(F.col(c).cast("long").alias(c) for c in cols), *([time] if horizon is not None else []))
    whole = whole.where(" and ".join(f"{c} is not null" for c in ("event_id", "time", *cols)))
    axes = [(c, reach, coarse * (reach + 1)) for c in by] + ([("time", horizon, coarse * (horizon + 1))] if horizon is not None else [])
    keys, home = [], F.lit(True)
    for k, (c, r, width) in enumerate(axes):
        cell = lambda shift, c=c, width=width: F.floor((F.col(c) + shift).cast("double") / width).cast("long")
        whole = whole.withColumn(f"g{k}", F.explode(F.sequence(cell(-r), cell(r))))
        keys.append(f"g{k}")
        home = home & (F.col(f"g{k}") == cell(0))
    lane = F.pmod(F.xxhash64("event_id"), F.lit(lanes)).cast("int")
    whole = whole.withColumn("lane", F.explode(F.array(*map(F.lit, range(lanes))))).withColumn("own", home & (F.col("lane") == lane))
    # a timer finds the cell of time as the last part of the key
    keys = ["lane", *keys]
    linker = Linker(cols, t, horizon, axes[-1][2] if horizon is not None else None)
    return whole.groupBy(*keys).transformWithStateInPandas(linker, LINKS, "append", "EventTime" if horizon is not None else "None")


def with_rocksdb(spark) -> None:
    """Streams that this session starts from now on keep their states in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def write_links(links: DataFrame, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Starts the stream into Parquet files at ``path``; started again with the same ``checkpoint`` it goes on where it stopped, each link is written once.

    now: takes what is there and ends.
    """
    writer = links.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer).start()


def labels(points: DataFrame, links: DataFrame) -> DataFrame:
    """event_id, comp of all ``points``: the smallest id of the component that the links so far make."""
    comps = connected_components(links)
    return points.select("event_id").distinct().join(comps, F.col("event_id") == F.col("id"), "left").select("event_id", F.coalesce("comp", "event_id").alias("comp"))
