"""Pairs of blocks dealt to tasks by what they cost.

Pairs are ranked by cost, dearest first, and dealt to the tasks to and fro, so two tasks differ by at most one dearest pair. There
are never more tasks than leave the mean above the dearest pair: the longest task takes less than twice the mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsforest.operators.ranking import global_rank
from epsforest.runtime import cut

#: So many of the dearest pairs a task takes at most where there is no smaller number of tasks.
PAIRS_A_TASK = 64


def dealt(pairs: DataFrame, cost: Column, tasks: int | None = None) -> tuple[DataFrame, int]:
    """pairs (i, j, ..) with ``cost`` and their ``task``, and the number of tasks: ``tasks``, or as the pairs and the session need, or fewer.

    A pair costs at least 1. Pairs are a small table: a row for two blocks of thousands of rows each.
    """
    spark = pairs.sparkSession
    costly = cut(pairs.withColumn("cost", F.greatest(F.lit(1), cost).cast("long")), "costs")
    row = costly.agg(F.sum("cost").alias("total"), F.max("cost").alias("most")).first()
    if row["total"] is None:
        return costly.withColumn("task", F.lit(0)), 1
    wanted = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), row["total"] // (PAIRS_A_TASK * row["most"]))
    number = max(1, min(wanted, row["total"] // row["most"]))
    ranked = global_rank(costly.withColumn("_least", -F.col("cost")), ["_least", "i", "j"], "_rank").drop("_least")
    turn = F.col("_rank") % (2 * number)
    return ranked.withColumn("task", F.least(turn, 2 * number - 1 - turn).cast("int")).drop("_rank"), number


def loads(pairs: DataFrame) -> DataFrame:
    """task, pairs, cost of dealt pairs."""
    return pairs.groupBy("task").agg(F.count("*").alias("pairs"), F.sum("cost").alias("cost"))


def _groups(run: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]]):
    """Calls ``run`` with the rows of each (i, j) of a partition that is sorted by them; holds one group at a time, and one frame of its results."""

    def found(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = run(pd.concat(held, ignore_index=True))
        yield from [out] if isinstance(out, pd.DataFrame) else out

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for x in batches:
            if not len(x):
                continue
            starts = [0, *((x[["i", "j"]] != x[["i", "j"]].shift()).any(axis=1).to_numpy().nonzero()[0][1:].tolist()), len(x)]
            for lo, hi in zip(starts, starts[1:]):
                now = (x["i"].iat[lo], x["j"].iat[lo])
                if key != now and held:
                    yield from found(held)
                    held = []
                key = now
                held.append(x.iloc[lo:hi])
        if held:
            yield from found(held)

    return stream


def each_pair(rows: DataFrame, pairs: DataFrame, number: int, run: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``run`` of the rows (block, ..) of each dealt pair, a frame or several; a pair is one group of one task, in the task that it was dealt to."""
    sides = pairs.select("i", "j", "task", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    placed = rows.join(sides, "block").repartitionById(number, "task").sortWithinPartitions("i", "j")
    return placed.mapInPandas(_groups(run), schema)
