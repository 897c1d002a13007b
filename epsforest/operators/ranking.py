"""A global row rank without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epsforest.runtime import cut


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the 0-based rank in ``order``: range partitions are sorted, and the counts of earlier partitions added.

    Only one row a partition is broadcast.
    """
    at = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_later"), before.alias("_start"))
    out = at.join(F.broadcast(starts), part == F.col("_later"))
    return out.withColumn(name, F.col("_start") + F.col("_at") - F.shiftleft(part, 33)).drop("_at", "_later", "_start")
