"""Command line: ``python -m epsforest.cli INPUT OUTPUT -f 1 -l 10 -s 0.1 ...`` scans; ``.. select ..`` leaves the selected and leftover
tables; ``.. extract ..`` reads results.

Inputs are headed CSV files, or with ``--binary`` the private tables. Sampling counts rows in the order of the input. A scan writes
``event_id,cluster`` as CSV, which ``extract`` takes as LABELS.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from epsforest.operators import extract as ex
from epsforest.operators.assign import assign_unassigned
from epsforest.operators.scan import Scan, resume
from epsforest.operators.select import select
from epsforest.operators.space import BLOCK
from epsforest.plans.pipeline import pipeline
from epsforest.runtime import clear, cut
from epsforest.sources.formats import BinaryTable, read_csv, read_table, write_csv, write_leftover, write_passes, write_selected
from epsforest.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epsforest")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-f", "--first", type=float, required=True)
    p.add_argument("-l", "--last", type=float)
    p.add_argument("-s", "--step", type=float, default=0.5)
    p.add_argument("-k", "--min-percent", type=float, default=0.5)
    p.add_argument("-n", "--min-events", type=int)
    p.add_argument("-p", "--stop-percent", type=float, default=95.0)
    p.add_argument("-g", "--stop-on-decrease", action="store_true", help="stop when fewer clusters are retained than before")
    p.add_argument("-U", "--nearest", action="store_true", help="also assign unassigned events to their nearest cluster")
    p.add_argument("-L", "--leftover", action="store_true", help="also assign held-out events, and write them to OUTPUT.leftover.clusters")
    p.add_argument("-M", "--history", help="write the history of the clusters there")
    p.add_argument("--passes", help="write the labels of every pass there")
    p.add_argument("--sample-every", type=int, default=1)
    p.add_argument("--flagged", action="store_true", help="the first column is a selection flag")
    p.add_argument("-q", "--quick", action="store_true", help="do not check the range of values")
    p.add_argument("-b", "--block-rows", type=int, default=BLOCK, help="rows of a block that is compared with others")
    p.add_argument("--store", help="keep points and edges there; if a scan is stored there already, go on from it (INPUT is not read then)")
    p.add_argument("--binary", action="store_true")
    return p


def select_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epsforest select")
    p.add_argument("input", help="a headed CSV file, or a folder of them")
    p.add_argument("output", help="OUTPUT.selected and OUTPUT.leftover are folders of binary tables")
    p.add_argument("-s", "--sample-every", type=int, default=1)
    p.add_argument("-f", "--flagged", action="store_true", help="the first column is a selection flag")
    p.add_argument("-k", "--key", type=int, help="the column to sort by; else that of the largest score")
    p.add_argument("-q", "--quick", action="store_true", help="do not check the range of values")
    return p


def extract_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epsforest extract")
    p.add_argument("input")
    p.add_argument("labels")
    p.add_argument("output", help="with --binary a folder of tables, else of CSV files")
    what = p.add_mutually_exclusive_group()
    what.add_argument("-c", "--cluster", type=int, help="one cluster only")
    what.add_argument("-u", "--unassigned", action="store_true")
    what.add_argument("-m", "--max-cluster", action="store_true", help="only the largest cluster number")
    what.add_argument("-s", "--summary", action="store_true", help="only the number of events of each cluster")
    p.add_argument("-0", "--no-label", action="store_true", help="leave the cluster column out; needs --cluster")
    p.add_argument("-b", "--renumber", action="store_true", help="the cluster becomes 1; needs --cluster")
    p.add_argument("--binary", action="store_true")
    return p


def _points(spark: SparkSession, path: str, binary: bool, flagged: bool = False, ordered: bool = False) -> DataFrame:
    return read_table(spark, path) if binary else read_csv(spark, path, flagged, ordered)


def run_extract(spark: SparkSession, args: list[str]) -> None:
    p = extract_parser()
    a = p.parse_args(args)
    if (a.no_label or a.renumber) and a.cluster is None:
        p.error("--no-label and --renumber need --cluster")
    labels = spark.read.schema("event_id long, cluster int").csv(a.labels, header=True)
    if a.max_cluster or a.summary:
        out = ex.max_cluster(labels) if a.max_cluster else ex.summary(labels).orderBy("cluster")
        return write_csv(out, a.output)
    points = _points(spark, a.input, a.binary)
    if a.unassigned:
        out, kind = ex.unassigned(points, labels), "unassigned"
    elif a.renumber:
        out, kind = ex.sub_extract(points, labels, a.cluster), "assigned"
    else:
        out, kind = ex.extract(points, labels, a.cluster), "assigned"
    if a.no_label:
        out, kind = out.drop("cluster"), "selected"
    if a.binary:
        out.write.format(BinaryTable.name()).mode("append").option("kind", kind).save(a.output)
    else:
        write_csv(out.orderBy("event_id"), a.output)


def run_select(spark: SparkSession, args: list[str]) -> None:
    a = select_parser().parse_args(args)
    points = read_csv(spark, a.input, a.flagged, ordered=True)
    names = spark.read.csv(a.input, header=True).columns[1 if a.flagged else 0 :]
    chosen = select(points, a.sample_every, "flag" if a.flagged else None, a.key, not a.quick, "position")
    write_selected(chosen, a.output.rstrip("/"), ",".join(names), a.sample_every, "position")
    chosen.counts().show()


def run_again(spark: SparkSession, a: argparse.Namespace) -> None:
    """A scan from a store, for other distances, sizes or stop rules."""
    found = resume(
        Store(spark, a.store), a.first, a.last, a.step, a.min_percent, a.min_events, a.stop_percent, not a.stop_on_decrease, block_rows=a.block_rows,
    )
    labels = cut(found.final_labels(), "final")
    write_csv(ex.final_union(assign_unassigned(found, labels) if a.nearest else labels), a.output)
    _reports(found, a)


def _reports(found: Scan, a: argparse.Namespace) -> None:
    if a.history:
        write_csv(found.history().orderBy("pass", "cluster"), a.history)
    if a.passes:
        write_passes(found, a.passes)
    found.report(a.sample_every, timed=True).show(1000, truncate=False)


def run_scan(spark: SparkSession, args: list[str]) -> None:
    a = parser().parse_args(args)
    if a.store and Store(spark, a.store).manifest:
        return run_again(spark, a)
    ordered = a.sample_every > 1 and not a.binary
    run = pipeline(
        _points(spark, a.input, a.binary, a.flagged, ordered), a.first, a.last, a.step, a.sample_every, "flag" if a.flagged else None, a.nearest, a.leftover,
        order="position" if ordered else "event_id", check=not a.quick, block_rows=a.block_rows, store=Store(spark, a.store) if a.store else None,
        min_percent=a.min_percent, min_events=a.min_events, stop_percent=a.stop_percent, go_on_decrease=not a.stop_on_decrease,
    )
    write_csv(run.result, a.output)
    if run.leftover_labels is not None:
        write_leftover(run.leftover_labels, a.output.rstrip("/") + ".leftover.clusters")
    _reports(run.scan, a)


def main(args: list[str] | None = None) -> None:
    args = sys.argv[1:] if args is None else args
    spark = SparkSession.builder.appName("epsforest").getOrCreate()
    try:
        if args[:1] == ["extract"]:
            run_extract(spark, args[1:])
        elif args[:1] == ["select"]:
            run_select(spark, args[1:])
        else:
            run_scan(spark, args)
    finally:
        clear(spark)


if __name__ == "__main__":
    main()
