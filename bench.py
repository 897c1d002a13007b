"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from epsforest.operators.assign import assign_unassigned  # noqa: E402
from epsforest.operators.neighbors import edges  # noqa: E402
from epsforest.operators.scan import scan  # noqa: E402
from epsforest.plans import catalogue as c  # noqa: E402
from epsforest.functions.schedule import threshold  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def full_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as points, every distance from 4 to 14."""
    return scan(c.cust2(spark, sf), 4, 14, 1, min_events=30, go_on_decrease=True).final_labels()


def line_scan(spark: SparkSession, sf: str) -> DataFrame:
    """600,000 rows on a lattice: equal vectors collapse first."""
    points = c.line3(spark, sf).drop("event_id").withColumn("event_id", F.monotonically_increasing_id())
    return scan(points.select("event_id", "c0", "c1", "c2"), 0.5, 1.5, 0.5, min_events=2, go_on_decrease=True, compat=False).final_labels()


def wide_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan(c.emb(spark, sf, 64), 130, 140, 5, min_events=4, go_on_decrease=True).final_labels()


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    found = scan(c.cust2(spark, sf), 4, 8, 1, min_events=30, go_on_decrease=True)
    return assign_unassigned(found, found.final_labels())


QUERIES = {
    "eps_edges": lambda s, d: edges(c.cust2(s, d), threshold(10, 2)),
    "scan_cust2": full_scan,
    "scan_line3": line_scan,
    "scan_emb64": wide_scan,
    "assign_nearest": nearest,
    "select_sample": c.QUERIES["sel_sample_every3"],
    "column_stats": c.QUERIES["sel_column_stats"],
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in QUERIES.items():
        took = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.time()
            query(spark, SF).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(statistics.median(took[1:] or took), 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
