"""The scan: components at rising thresholds, the tree of their births and mergers, and the leaf clusters.

The minimum spanning forest of the distinct vectors serves all passes; it stays a table. What a pass changes is recorded, not
what it leaves alone: a retained component is a node with the passes [since, until) in which it is the same, and the
node that takes it in. So storage grows with the mergers and not with the passes. Every vector knows the birth whose
cluster it enters (its chain), which is all that labels need.

While more edges are left than a task should take, a pass is a distributed contraction. Once the rest is small (counted), one task
on an executor runs the remaining passes over it; neither forest nor labels come to the driver.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epsforest.functions.points import columns_of
from epsforest.functions.schedule import Pass, Schedule, grid, minimum_size, threshold
from epsforest.operators import forest as fo
from epsforest.operators import space
from epsforest.operators.components import connected_components
from epsforest.operators.neighbors import collapse
from epsforest.operators.skew import split_join
from epsforest.runtime import cut
from epsforest.sources.store import Store

#: Edges, and vectors or components, that one task takes at most; beyond, passes are distributed.
FEW = 500_000
#: Blocks of points that are spanned at once up to the last threshold; more of them go by bands of thresholds.
FEW_BLOCKS = 16

#: Rows that go into and come out of a task that runs passes.
TASK = "kind string, comp long, size long, births long, chain long, chain_pass int, since int, until int, up long, last long, entered boolean, u long, v long, d2 long, seconds double"
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
#: Stands for a null among whole numbers.
NONE = np.iinfo(np.int64).min


@dataclass
class Scan:
    """Results of a scan.

    nodes: (comp, since, until, up, size, births, birth, chain, chain_pass) of the retained components: unchanged in the passes
    since .. until - 1, then part of ``up`` (null: until the end); a component is named by its smallest event. births: how many it
    holds; chain and chain_pass: the one birth of such that hold one. members: (event_id, weight, chain, chain_pass, last) of
    the vectors: the birth they count to, if they entered before it met another, and their component after the last pass.
    """

    points: DataFrame
    vectors: DataFrame
    forest: DataFrame
    nodes: DataFrame
    members: DataFrame
    schedule: Schedule
    minimum: int
    columns: int
    compat: bool = True
    few: int = FEW
    #: How many events there are, and whether all are distinct vectors.
    events: int = 0
    distinct: bool = False

    @property
    def last_pass(self) -> int:
        return self.schedule.passes[-1].index

    def stats(self) -> DataFrame:
        """A row a pass."""
        rows = [(p.index, p.dist, p.threshold, p.raw, p.retained, p.assigned, p.events - p.assigned) for p in self.schedule.passes]
        return self.points.sparkSession.createDataFrame(rows, "pass int, dist double, threshold long, raw long, retained long, assigned long, unassigned long")

    def report(self, sample_every: int = 1, timed: bool = False) -> DataFrame:
        """A row a pass with what share of the events is assigned, in float32 as the stop rules have it; ``timed`` adds seconds and workers."""
        spark = self.points.sparkSession
        rows = [(p.index, p.dist, sample_every, p.events, p.assigned, p.events - p.assigned, float(p.percent), p.raw, p.retained) for p in self.schedule.passes]
        schema = "pass int, dist double, sample_every int, events long, assigned long, unassigned long, percent double, raw long, retained long"
        if timed:
            workers = spark.sparkContext.defaultParallelism
            rows = [(*r, s, workers) for r, s in zip(rows, self.schedule.seconds, strict=True)]
            schema += ", seconds double, workers int"
        return spark.createDataFrame(rows, schema)

    def retained(self) -> DataFrame:
        """pass, comp, size of the components of the minimum size or more."""
        return self._by_pass().select("pass", "comp", "size")

    def _by_pass(self) -> DataFrame:
        """A row for each pass in which a node is."""
        return self.nodes.withColumn("pass", F.explode(F.sequence("since", F.col("until") - 1)))

    def _chosen(self) -> DataFrame:
        """The nodes that are clusters: they hold one birth and merge into one that holds more, or the scan ends; with ``compat``, not if born in the last pass."""
        last = F.col("until") == self.last_pass + 1
        above = self.nodes.select(F.col("since").alias("until"), F.col("comp").alias("up"), F.col("births").alias("above"))
        x = self.nodes.where("births = 1").join(above, ["until", "up"], "left").where(last | (F.col("above") >= 2))
        return x.where(~(last & F.col("birth") & (F.col("since") == self.last_pass))) if self.compat else x

    def lineage(self) -> DataFrame:
        """pass, comp, size, birth, births (how many it holds), parent, siblings, merged_to, descends_from, selected.

        births are components without a member that was retained one pass earlier. A component is selected if it holds
        one birth and merges into one that holds more, or the scan ends; with ``compat``, not if it is born in the last pass.
        """
        chosen = self._chosen().select("comp", (F.col("until") - 1).alias("pass"), F.lit(True).alias("selected"))
        ends = F.col("pass") == F.col("until") - 1
        x = self._by_pass().withColumn("parent", F.when(F.col("pass") == self.last_pass, F.lit(None)).when(ends, F.col("up")).otherwise(F.col("comp")))
        x = cut(x.withColumn("birth", F.col("birth") & (F.col("pass") == F.col("since"))).select("pass", "comp", "size", "birth", "births", "parent"), "by-pass")
        family = x.where("parent is not null").groupBy("pass", "parent").agg(F.count("*").alias("siblings"), F.min("comp").alias("first"))
        down = family.select((F.col("pass") + 1).alias("pass"), F.col("parent").alias("comp"), F.col("first").alias("descends_from"))
        x = x.join(family, ["pass", "parent"], "left").join(down, ["pass", "comp"], "left").join(chosen, ["pass", "comp"], "left")
        return x.select(
            "pass", "comp", "size", "birth", "births", "parent", F.coalesce("siblings", F.lit(0)).alias("siblings"),
            F.when((F.col("siblings") > 1) & (F.col("comp") != F.col("first")), F.col("first")).alias("merged_to"), "descends_from", F.coalesce("selected", F.lit(False)).alias("selected"),
        )

    def history(self) -> DataFrame:
        """pass, dist, cluster (numbered inside its pass), size, descendfrom (of the pass before), mergedto (of the same pass), retain; 0 is none."""
        rows = cut(self.lineage(), "lineage").withColumn("cluster", F.row_number().over(Window.partitionBy("pass").orderBy("comp")))
        rows = cut(rows, "history")  # a row a retained cluster and pass
        number = rows.select("pass", "comp", "cluster")
        before = number.select((F.col("pass") + 1).alias("pass"), F.col("comp").alias("descends_from"), F.col("cluster").alias("descendfrom"))
        beside = number.select("pass", F.col("comp").alias("merged_to"), F.col("cluster").alias("mergedto"))
        dist = self.points.sparkSession.createDataFrame([(p.index, p.dist) for p in self.schedule.passes], "pass int, dist double")
        rows = rows.join(before, ["pass", "descends_from"], "left").join(beside, ["pass", "merged_to"], "left").join(F.broadcast(dist), "pass")
        none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return rows.select("pass", "dist", "cluster", "size", none("descendfrom"), none("mergedto"), F.col("selected").alias("retain"))

    def _numbered(self) -> DataFrame:
        # one row a cluster: the report of a scan, orders of magnitude below its events
        number = F.row_number().over(Window.orderBy("pass", "comp")).alias("cluster")
        return self._chosen().withColumn("pass", F.col("until") - 1).select(number, "pass", "comp", "size", "chain", "chain_pass")

    def clusters(self) -> DataFrame:
        """cluster (from 1, by pass and smallest id), pass, comp, size of the selected components."""
        return self._numbered().select("cluster", "pass", "comp", "size")

    def final_labels(self) -> DataFrame:
        """event_id, cluster of every event; 0 is unassigned."""
        labels = self.members.where("chain is not null").join(self._numbered(), ["chain", "chain_pass"]).select("event_id", "cluster")
        return self._of_points(labels, "cluster", 0)

    def _of_points(self, labels: DataFrame, name: str, missing: int | None = None) -> DataFrame:
        """The value of each event's vector; without ``missing``, of the events that have one."""
        cols = columns_of(self.points)
        x = self.vectors.join(labels, "event_id", "inner" if missing is None else "left")
        x = x if missing is None else x.withColumn(name, F.coalesce(name, F.lit(missing)))
        alone = F.col("weight") == 1  # its event_id is the event's
        if self.distinct:
            return x.select("event_id", name)
        many = self.vectors.where(~alone).select(*cols, "weight", F.col("event_id").alias("_vector"))
        counts = many.select(*cols, F.col("weight").alias("n"))
        events = split_join(self.points, many.drop("weight"), cols, counts, self.events).select("event_id", "_vector")
        shared = events.join(x.where(~alone).select(F.col("event_id").alias("_vector"), name), "_vector")
        return x.where(alone).select("event_id", name).unionByName(shared.select("event_id", name))

    def vector_labels_at(self, index: int) -> DataFrame:
        """event_id, comp of the distinct vectors at a pass."""
        t = max(p.threshold for p in self.schedule.passes[: index + 1])  # labels carry over: a falling threshold splits nothing
        near = self.forest.where(F.col("d2") <= t)
        found = connected_components(near).select(F.col("id").alias("event_id"), "comp") if near.count() > self.few else _components_in_a_task(near)
        return self.vectors.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("comp", "event_id").alias("comp"))

    def labels_at(self, index: int) -> DataFrame:
        """event_id, comp of every event at a pass; equal vectors share a component of their smallest id."""
        return self._of_points(self.vector_labels_at(index), "comp")

    def last_labels(self) -> DataFrame:
        """event_id, comp in the last pass, of events in a component of two events or more, retained or not."""
        last = self.members.select("event_id", "weight", F.col("last").alias("comp"))
        big = last.groupBy("comp").agg(F.sum("weight").alias("n")).where("n >= 2").select("comp")
        return self._of_points(last.join(big, "comp").select("event_id", "comp"), "comp")


def _components_in_a_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat([pd.DataFrame({"a": [], "b": []}).astype("int64"), *batches])
        ids, ends = np.unique(np.concatenate([x["a"], x["b"]]).astype(np.int64), return_inverse=True)
        up = np.arange(len(ids))
        _unite(up, ends[: len(x)], ends[len(x) :])
        yield pd.DataFrame({"event_id": ids, "comp": ids[up]})

    return edges.select("a", "b").coalesce(1).mapInPandas(run, "event_id long, comp long")


def _unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b; afterwards every element points to the first of its set."""
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        up[max(x, y)] = min(x, y)
    while not np.array_equal(up, up[up]):
        up[:] = up[up]


def _passes_in_a_task(plan: Schedule, top: int, reach: int, minimum: int, columns: int, events: int, others: int):
    """Runs passes over the components and edges of one task until the schedule ends or its next threshold is above ``reach``.

    Rows in: ``comp`` (COMPS) and ``edge`` (u, v, d2). Rows out: ``comp`` as they are then, ``node`` that ended, ``unit`` (comp, last and
    the chain at which it entered a retained component, entered) for every component that came in, ``pass`` with its figures.
    others: components of two events or more that are in no edge and can't become retained.
    """
    schema = pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in TASK.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = list(batches)
        x = pa.Table.from_batches(given) if given else schema.empty_table()
        comps, edges = (x.filter(pc.equal(x["kind"], kind)).sort_by(by) for kind, by in (("comp", "comp"), ("edge", "d2")))
        whole = lambda t, c: t[c].cast(pa.int64()).fill_null(NONE).to_numpy().copy()
        ids, d2 = whole(comps, "comp"), whole(edges, "d2")
        u, v = (np.searchsorted(ids, whole(edges, c)) for c in ("u", "v"))
        n, own = len(ids), np.arange(len(ids))
        weight, births, chain, chain_pass, since = (whole(comps, c) for c in ("size", "births", "chain", "chain_pass", "since"))
        up, size, entered = own.copy(), weight.copy(), since >= 0
        unit_chain, unit_pass = np.full(n, NONE), np.full(n, NONE)
        schedule, highest, done = copy.deepcopy(plan), top, 0
        out = []
        while True:
            t = max(threshold(schedule.dist, columns), highest)
            if t > reach:
                break
            highest, index, began = t, len(schedule.passes), time.monotonic()
            end, before, held = int(np.searchsorted(d2, t, "right")), up.copy(), size
            _unite(up, u[done:end], v[done:end])
            done = end
            size = np.bincount(up, weights=weight, minlength=n).astype(np.int64)
            root = up == own
            merged = np.zeros(n, bool)
            merged[up[up != before]] = True
            kept = root & (size >= minimum)
            ended = np.flatnonzero((since >= 0) & merged[up])  # only roots of the pass before have a ``since``
            until = np.full(len(ended), index)
            out.append({"kind": "node", "comp": ids[ended], "since": since[ended], "until": until, "up": ids[up[ended]], "size": held[ended], "births": births[ended], "chain": chain[ended], "chain_pass": chain_pass[ended]})
            to, parts = up[ended], np.bincount(up[ended], minlength=n)
            total = np.bincount(to, weights=births[ended], minlength=n).astype(np.int64)
            from_chain, from_pass = np.full(n, NONE), np.full(n, NONE)
            from_chain[to], from_pass[to] = chain[ended], chain_pass[ended]  # read only where there is one part
            since[ended] = births[ended] = NONE
            new = np.flatnonzero(kept & (since < 0))
            born, one = parts[new] == 0, total[new] == 1
            births[new], since[new] = np.where(born, 1, total[new]), index
            chain[new] = np.where(born, ids[new], np.where(one, from_chain[new], NONE))
            chain_pass[new] = np.where(born, index, np.where(one, from_pass[new], NONE))
            fresh = np.flatnonzero(~entered & kept[up])
            entered[fresh], unit_chain[fresh], unit_pass[fresh] = True, chain[up[fresh]], chain_pass[up[fresh]]
            now = Pass(index, float(schedule.dist), t, int((size[root] >= 2).sum()) + others, int(kept.sum()), int(size[kept].sum()), events)
            figures = {"comp": index, "size": now.raw, "births": now.retained, "up": now.assigned, "d2": t, "seconds": time.monotonic() - began}
            out.append({"kind": "pass"} | {k: np.array([f]) for k, f in figures.items()})
            if schedule.done(now):
                break
        root = np.flatnonzero(up == own)
        state = {"comp": ids[root], "size": size[root], "births": births[root], "chain": chain[root], "chain_pass": chain_pass[root], "since": since[root]}
        units = {"comp": ids, "last": ids[up], "size": weight, "chain": unit_chain, "chain_pass": unit_pass, "entered": entered}
        out += [{"kind": "comp"} | state, {"kind": "unit"} | units]
        for part in out:
            rows = len(part["comp"])
            filled = {"kind": np.full(rows, part["kind"], object)} | {k: v for k, v in part.items() if k != "kind"}
            arrays = []
            for f in schema:
                v = filled.get(f.name)
                whole_number = v is not None and np.issubdtype(np.asarray(v).dtype, np.integer)
                arrays.append(pa.nulls(rows, f.type) if v is None else pa.array(v, mask=np.asarray(v) == NONE if whole_number else None).cast(f.type))
            if rows:
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _tagged(df: DataFrame, kind: str) -> DataFrame:
    names = [c.split() for c in TASK.split(", ")]
    return df.select(*(F.lit(kind).alias("kind") if c == "kind" else (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in names))


class _State:
    """Components, what is known of each vector, and the edges between components, from pass to pass."""

    def __init__(self, vectors: DataFrame, plan: Schedule, minimum: int, columns: int, events: int, few: int, size: int) -> None:
        none = {"births": F.lit(None).cast("long"), "chain": F.lit(None).cast("long"), "chain_pass": F.lit(None).cast("int"), "since": F.lit(None).cast("int")}
        self.plan, self.minimum, self.columns, self.events, self.few = plan, minimum, columns, events, few
        self.size = size  # components at most
        self.comps = vectors.select(F.col("event_id").alias("comp"), F.col("weight").alias("size")).withColumns(none)
        self.members = vectors.select("event_id", "weight", F.col("event_id").alias("comp"), F.lit(False).alias("entered")).withColumns({k: none[k] for k in ("chain", "chain_pass")})
        self.edges: DataFrame | None = None
        self.closed: list[DataFrame] = []
        self.top, self.over, self.untouched = -1, False, True

    def add(self, edges: DataFrame) -> None:
        """More edges (u, v, d2) between components."""
        self.edges = edges if self.edges is None else cut(self.edges.unionByName(edges), "edges")

    def next_threshold(self) -> int:
        return max(threshold(self.plan.dist, self.columns), self.top)

    def go_on(self, reach: int) -> None:
        """Passes up to ``reach``: all in one task if the components that may change are few, else one by one."""
        while not self.over and self.next_threshold() <= reach:
            units = self.comps
            if self.few and self.size > self.few:
                self.size = self.comps.count()
            if self.few and self.size > self.few:
                ends = self.edges.select(F.col("u").alias("comp")).unionByName(self.edges.select(F.col("v").alias("comp"))).distinct()
                units = cut(self.comps.join(ends.withColumn("_in", F.lit(True)), "comp", "left").where(F.col("_in") | F.col("since").isNotNull() | (F.col("size") >= self.minimum)).drop("_in"), "units")
            if self.few and (self.size <= self.few or units.count() <= self.few):
                self._in_a_task(units, reach)
            else:
                self._one_pass()

    def _in_a_task(self, units: DataFrame, reach: int) -> None:
        whole = units is self.comps
        others = 0 if whole else self.comps.join(units.select("comp"), "comp", "left_anti").where("size >= 2").count()
        run = _passes_in_a_task(self.plan, self.top, reach, self.minimum, self.columns, self.events, others)
        out = cut(_tagged(units, "comp").unionByName(_tagged(self.edges, "edge")).coalesce(1).mapInArrow(run, TASK), "passes")
        for r in out.where("kind = 'pass'").orderBy("comp").collect():
            self.top = r["d2"]
            self.over = self.plan.done(Pass(r["comp"], float(self.plan.dist), r["d2"], r["size"], r["births"], r["up"], self.events))
            self.plan.seconds[-1] = r["seconds"]
        self.closed.append(out.where("kind = 'node'").select("comp", "since", "until", "up", "size", "births", "chain", "chain_pass"))
        comps = out.where("kind = 'comp'").select(*self.comps.columns)
        unit = out.where("kind = 'unit'").select("comp", "last", "size", F.col("entered").alias("_entered"), F.col("chain").alias("_chain"), F.col("chain_pass").alias("_pass"))
        if self.untouched and whole:  # the components that came in are the vectors
            self.members = unit.select(F.col("comp").alias("event_id"), F.col("size").alias("weight"), F.col("last").alias("comp"), F.col("_entered").alias("entered"), F.col("_chain").alias("chain"), F.col("_pass").alias("chain_pass"))
        else:
            x = self.members.join(unit.drop("size"), "comp", "left")
            fresh = ~F.col("entered") & F.coalesce("_entered", F.lit(False))
            x = x.select("event_id", "weight", F.coalesce("last", "comp").alias("comp"), (F.col("entered") | fresh).alias("entered"), F.when(fresh, F.col("_chain")).otherwise(F.col("chain")).alias("chain"), F.when(fresh, F.col("_pass")).otherwise(F.col("chain_pass")).alias("chain_pass"))
            self.members = cut(x, "members")
        self.comps = comps if whole else cut(comps.unionByName(self.comps.join(units.select("comp"), "comp", "left_anti")), "comps")
        self.untouched = False
        if not self.over:
            self._relabel(unit.select(F.col("comp").alias("id"), F.col("last").alias("comp")))

    def _relabel(self, to: DataFrame) -> None:
        x = self.edges.where(F.col("d2") > self.top)
        for c in ("u", "v"):
            x = x.join(to.select(F.col("id").alias(c), F.col("comp").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        self.edges = cut(x.where("u <> v"), "edges")

    def _one_pass(self) -> None:
        """A pass as a contraction of all components by joins and aggregations."""
        self.top, index, self.untouched = self.next_threshold(), len(self.plan.passes), False
        to = cut(connected_components(self.edges.where(F.col("d2") <= self.top), "u", "v"), "contracted")
        x = cut(self.comps.join(to.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").withColumn("root", F.coalesce("root", "comp")), "merging")
        was = F.col("since").isNotNull()
        of = lambda f, c: f(F.when(was, F.col(c)))
        g = x.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count("since").alias("parts"), of(F.sum, "births").alias("total"), of(F.max, "chain").alias("_chain"), of(F.max, "chain_pass").alias("_pass"), F.max("since").alias("_since"))
        g = cut(g, "merged")
        changed, kept, born = F.col("n") > 1, F.col("size") >= self.minimum, F.col("parts") == 0
        one = F.col("total") == 1
        stays = ~changed & ~born
        here = F.lit(index).cast("int")
        self.closed.append(x.where(was).join(g.where(changed).select("root"), "root").select("comp", "since", here.alias("until"), F.col("root").alias("up"), "size", "births", "chain", "chain_pass"))
        comps = g.select(
            F.col("root").alias("comp"), "size", F.when(kept, F.when(born, F.lit(1).cast("long")).otherwise(F.col("total"))).alias("births"),
            F.when(kept, F.when(born, F.col("root")).when(one, F.col("_chain"))).alias("chain"), F.when(kept, F.when(born, here).when(one, F.col("_pass"))).alias("chain_pass"),
            F.when(kept, F.when(stays, F.col("_since")).otherwise(here)).alias("since"),
        )
        self.comps = cut(comps, "comps")
        y = self.members.join(to.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        fresh = self.comps.where("since is not null").select("comp", F.col("chain").alias("_chain"), F.col("chain_pass").alias("_pass"), F.lit(True).alias("_kept"))
        y = y.join(fresh, "comp", "left")
        enters = ~F.col("entered") & F.col("_kept").isNotNull()
        y = y.select("event_id", "weight", "comp", (F.col("entered") | enters).alias("entered"), F.when(enters, F.col("_chain")).otherwise(F.col("chain")).alias("chain"), F.when(enters, F.col("_pass")).otherwise(F.col("chain_pass")).alias("chain_pass"))
        self.members = cut(y, "members")
        self._relabel(to)
        r = self.comps.agg(F.count_if(F.col("size") >= 2).alias("raw"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("assigned")).first()
        self.over = self.plan.done(Pass(index, float(self.plan.dist), self.top, r["raw"], r["kept"], r["assigned"], self.events))

    def nodes(self) -> DataFrame:
        """All nodes, those that are there at the end included."""
        alive = self.comps.where("since is not null").withColumns({"until": F.lit(len(self.plan.passes)), "up": F.lit(None).cast("long")})
        x = reduce(DataFrame.unionByName, [*self.closed, alive.select("comp", "since", "until", "up", "size", "births", "chain", "chain_pass")])
        return x.withColumn("birth", (F.col("births") == 1) & (F.col("chain_pass") == F.col("since")))


def scan(
    points: DataFrame, first: float, last: float | None = None, step: float = 0.5, min_percent: float = 0.5, min_events: int | None = None, stop_percent: float = 95.0,
    go_on_decrease: bool = False, compat: bool = True, few: int = FEW, dimensions: int | None = None, block_rows: int = space.BLOCK, few_blocks: int = FEW_BLOCKS,
    store: Store | None = None,
) -> Scan:
    """Scans distances ``first`` to ``last``. points: (event_id, c0 ..); ids are distinct. Missing ids and features are refused.

    The forest is found in bands if there are more than ``few_blocks`` blocks of ``block_rows`` vectors: the first reaches the first threshold,
    each next one about twice the distance, between points of different components. few: components that one task takes at most; with 0 every
    pass is distributed. dimensions: the number of columns that thresholds reckon with, if some columns only hold points apart.
    store: keeps points and edges, band by band, for ``resume``.
    """
    cols = columns_of(points)
    points = cut(points.select("event_id", *cols), "points")
    missing = reduce(lambda x, y: x | y, (F.col(c).isNull() for c in cols))
    check = points.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("d"), F.count_if(missing).alias("missing"), *space.ends_of(points)).first().asDict()
    if check["n"] != check["d"]:
        raise ValueError("event ids repeat or are missing")
    if check["missing"]:
        raise ValueError(f"features are missing in {check['missing']} events; leave these out or give them values")
    vectors = cut(collapse(points), "vectors")
    size, width = vectors.count(), dimensions or len(cols)
    if store:
        store.begin(points, vectors, check["n"], size, width, threshold(first, width))
    plan = Schedule(first, last, step, stop_percent, go_on_decrease)
    minimum = minimum_size(check["n"], min_percent, min_events)
    found = Scan(points, vectors, points, points, points, plan, minimum, width, compat, few or FEW, check["n"], size == check["n"])
    return _run(found, size, few, block_rows, few_blocks, store, check)


def resume(
    store: Store, first: float, last: float | None = None, step: float = 0.5, min_percent: float = 0.5, min_events: int | None = None, stop_percent: float = 95.0,
    go_on_decrease: bool = False, compat: bool = True, few: int = FEW, block_rows: int = space.BLOCK, few_blocks: int = FEW_BLOCKS,
) -> Scan:
    """A scan over the points and edges of a store, for other distances, sizes or stop rules. Only thresholds beyond its reach need new edges, which it keeps.

    ``first`` may not be less than the stored scan's: distances below that were not told apart.
    """
    m = store.manifest
    if m is None:
        raise ValueError(f"no scan is stored in {store.path}")
    if threshold(first, m.columns) < m.floor:
        raise ValueError("the first distance is less than that of the stored scan")
    points, vectors = store.table(m.points), store.table(m.vectors)
    plan = Schedule(first, last, step, stop_percent, go_on_decrease)
    found = Scan(points, vectors, points, points, points, plan, minimum_size(m.events, min_percent, min_events), m.columns, compat, few or FEW, m.events, m.distinct == m.events)
    return _run(found, m.distinct, few, block_rows, few_blocks, store)


def _run(found: Scan, size: int, few: int, block_rows: int, few_blocks: int, store: Store | None, ends: dict | None = None) -> Scan:
    """Passes over the forest, which grows by bands of thresholds; fills in ``forest``, ``nodes`` and ``members``. size: the number of vectors."""
    plan, width, vectors = found.schedule, found.columns, found.vectors
    first, floor = float(plan.first), threshold(plan.first, width)
    distances = [threshold(d, width) for d in grid(first, float(plan.last), float(plan.step))] if first <= float(plan.last) else [floor]
    state, forest, laid = _State(vectors, plan, found.minimum, width, found.events, few, size), [], None
    if store and store.manifest.bands:
        forest.append(store.forest())
        state.add(forest[0].select(F.col("a").alias("u"), F.col("b").alias("v"), "d2"))
        state.go_on(store.manifest.reach)
    while not state.over:
        laid = laid or space.lay(vectors.drop("weight"), floor, block_rows, facts=ends | {"n": size} if ends else None)
        t = state.next_threshold()
        # a step that doubles may pass a threshold that the grid does not have
        reach = max(t, max(distances) if laid.count <= few_blocks else min(max(distances), 4 * t))
        if forest:
            again = space.Blocks(laid.rows.join(state.members.select("event_id", "comp"), "event_id"), laid.bounds, laid.count, laid.columns, laid.pivots, laid.celled)
            more = fo.candidates(again, reach, label="comp")
        else:
            more = fo.candidates(laid, reach, floor)
        # of few blocks, a task takes the edges of all pairs as they are
        more = cut(more if laid.count <= few_blocks else fo.spanning_forest(more, few or FEW), "forest")
        if store:
            store.add(more, reach)
        forest.append(more.select("a", "b", "d2"))
        state.add(more.select("u", "v", "d2"))
        state.go_on(reach)
    members = state.members.select("event_id", "weight", "chain", "chain_pass", F.col("comp").alias("last"))
    return replace(found, forest=reduce(DataFrame.unionByName, forest), nodes=state.nodes(), members=members)
