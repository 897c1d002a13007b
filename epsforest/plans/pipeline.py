"""The whole run: select, scan, assign, union."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from epsforest.operators.assign import assign_leftover, assign_unassigned
from epsforest.operators.extract import final_union
from epsforest.operators.scan import Scan, scan
from epsforest.operators.select import Selection, select
from epsforest.runtime import cut


@dataclass
class Run:
    """A finished run; ``labels`` are the scanned events', ``result`` all events'."""

    selection: Selection
    scan: Scan
    labels: DataFrame
    leftover_labels: DataFrame | None
    result: DataFrame


def pipeline(
    points: DataFrame, first: float, last: float | None = None, step: float = 0.5, sample_every: int = 1, flag: str | None = None, nearest: bool = False, leftover: bool = False, order: str = "event_id",
    check: bool = True, **options,
) -> Run:
    """``nearest`` also assigns unassigned events, ``leftover`` the held-out ones. A run goes on when clusters decrease.

    order: the column in whose order every ``sample_every``-th event is taken; check: refuse values out of range.
    """
    chosen = select(points, sample_every, flag, check=check, order=order)
    found = scan(chosen.points, first, last, step, **({"go_on_decrease": True} | options))
    labels = cut(found.final_labels(), "final")
    if nearest:
        labels = cut(assign_unassigned(found, labels), "final")
    rest = assign_leftover(found, labels, chosen.leftover) if leftover and chosen.leftover is not None else None
    return Run(chosen, found, labels, rest, final_union(labels, rest))
