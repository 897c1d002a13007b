"""Minimum spanning forests of points: blocks are spanned pairwise where they can be near, and the union is thinned by Borůvka rounds.

The forest of all points lies in the union of the forests of all pairs of blocks (an edge that is heaviest on a cycle of a
part is so of the whole), so each pair that the space-partition tree leaves is one bounded group, and only its edges between the two blocks are
kept. Points of one component are held together at no cost: they are compared with others only, and blocks that lie in one component
are not compared with each other. Of the block pairs of two components, those farther apart than the largest distance of another pair are
left out as well.

``floor``: distances up to it are as good as equal. Cells whose points are all within it are components from the start,
joined by a star, so that a dense cell costs no pairs; and of two such cells, one closest pair says all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.operators import balance, space
from epsforest.operators.components import connected_components
from epsforest.runtime import cut

#: Edges of points and their squared distance; u and v are what they join: the points or their components.
EDGES = "a long, b long, d2 long, u long, v long"
#: Rows of a group that are compared with all others at a time.
CHUNK = 64


def span(x: np.ndarray, label: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2, joined): a minimum spanning forest of the rows of ``x`` by Prim's rule, of squared distances up to ``most``.

    Rows of one label count as one; where a group of them is entered, its rows are ``joined`` to the one entered first.
    """
    n, wide = len(x), x.shape[1] > 8
    order = np.argsort(label, kind="stable")
    firsts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]]) if n else np.zeros(0, np.int64)
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(np.r_[False, label[order][1:] != label[order][:-1]]) if n else 0
    ends = np.r_[firsts[1:], n]
    alone = len(firsts) == n
    left = np.arange(n)  # rows that may still be reached
    y = x if wide else np.ascontiguousarray(x.T)
    norms = (x * x).sum(axis=1) if wide else None
    yn = norms
    best, source, alive = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    out_i, out_j, out_d, joined = [], [], [], []
    at, gone, place = 0, 0, np.arange(n)  # where each row stands in the shrunken arrays
    while gone < n:
        members = order[firsts[group[at]] : ends[group[at]]] if not alone else np.array([at])
        if len(members) > 1:
            rest = members[members != at]
            out_i.append(np.full(len(rest), at))
            out_j.append(rest)
            d = x[rest] - x[at]
            out_d.append((d * d).sum(axis=1))
            joined.append(np.ones(len(rest), bool))
        alive[place[members]] = False
        best[place[members]] = np.inf
        gone += len(members)
        if gone == n:
            break
        if 2 * gone > n and len(left) > 256 and alive.sum() * 2 < len(left):
            left, best, source = left[alive], best[alive], source[alive]
            y = y[alive] if wide else np.ascontiguousarray(y[:, alive])
            yn = yn[alive] if wide else None
            place[left] = np.arange(len(left))
            alive = np.ones(len(left), bool)
        size = CHUNK if len(members) > 4 else 1
        for lo in range(0, len(members), size):
            part = members[lo : lo + size]
            if len(part) == 1:
                p = x[part[0]]
                if wide:
                    d = yn - 2 * (y @ p) + norms[part[0]]
                else:
                    d = (y[0] - p[0]) ** 2
                    for c in range(1, len(p)):
                        e = y[c] - p[c]
                        e *= e
                        d += e
                closer = d < best
                closer &= alive
                best[closer] = d[closer]
                source[closer] = part[0]
            else:
                p = x[part]
                if wide:
                    d = yn[None] - 2 * (p @ y.T) + norms[part][:, None]
                else:
                    d = (y[0][None] - p[:, 0][:, None]) ** 2
                    for c in range(1, p.shape[1]):
                        e = y[c][None] - p[:, c][:, None]
                        e *= e
                        d += e
                who = d.argmin(axis=0)
                d = d[who, np.arange(d.shape[1])]
                closer = (d < best) & alive
                best[closer] = d[closer]
                source[closer] = part[who[closer]]
        k = int(best.argmin())
        if np.isinf(best[k]):  # all distances are finite: only rows that are gone
            k = int(alive.argmax())
        at = int(left[k])
        if best[k] <= most:
            out_i.append(np.array([source[k]]))
            out_j.append(np.array([at]))
            out_d.append(np.array([best[k]]))
            joined.append(np.zeros(1, bool))
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_d), np.concatenate(joined)


def forest_of(a: np.ndarray, b: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Which edges a minimum spanning forest keeps, edges ordered by (d2, a, b)."""
    order = np.lexsort((b, a, d2))
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = where[: len(a)][order].tolist(), where[len(a) :][order].tolist()
    up = list(range(len(ids)))
    kept = []
    for k in range(len(u)):
        x, y = u[k], v[k]
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    return order[np.array(kept, np.int64)]


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["a", "b", "d2", "u", "v"]
    thin = lambda x: x.iloc[forest_of(*(x[c].to_numpy(np.int64) for c in ("u", "v", "d2")))] if len(x) else x
    held, rest, waiting = pd.DataFrame({c: [] for c in names}).astype("int64"), [], 0
    for x in batches:
        rest.append(x[names])
        waiting += len(x)
        if waiting > max(200_000, len(held)):  # at least half of what is sorted is new
            held, rest, waiting = thin(pd.concat([held, *rest], ignore_index=True)), [], 0
    yield thin(pd.concat([held, *rest], ignore_index=True))


def local_forests(found: DataFrame) -> DataFrame:
    """Each partition's minimum spanning forest. Their union has the same components at every threshold as all edges."""
    return found.select("a", "b", "d2", "u", "v").mapInPandas(_local_forest, EDGES)


def _spanned(cols: list[str], most: int, floor: int, label: str | None, links: bool):
    """Edges of one group: a block's own forest, or what a pair's forest has between its two blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, ids, block = space.frame(rows, cols), rows["event_id"].to_numpy(np.int64), rows["block"].to_numpy()
        mark = rows[label].to_numpy(np.int64) if label else np.arange(len(rows))
        first = block == block.min()
        if not first.all():  # only rows within reach of the other block's box can be joined with it
            near = np.zeros(len(rows), bool)
            for own in (first, ~first):
                low, high = x[~own].min(axis=0), x[~own].max(axis=0)
                gap = np.maximum(0, np.maximum(low - x[own], x[own] - high))
                near[own] = (gap * gap).sum(axis=1) <= most
            if not (near & first).any() or not (near & ~first).any():
                return pd.DataFrame({c: [] for c in ("a", "b", "d2", "u", "v")}).astype("int64")
            x, ids, block, mark = x[near], ids[near], block[near], mark[near]
        low, high = x.min(axis=0), x.max(axis=0)
        if links and ((high - low) ** 2).sum() <= floor:
            mark = np.zeros(len(x), np.int64)  # all within the floor of each other
        i, j, d2, joined = span(x, mark, most)
        pair = block.min() != block.max()
        keep = block[i] != block[j] if pair else np.ones(len(i), bool)
        if not links:
            keep &= ~joined
        i, j = i[keep], j[keep]
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        ends = (ids[i], ids[j]) if links else (mark[i], mark[j])
        return pd.DataFrame({"a": ids[i], "b": ids[j], "d2": d2[keep].astype(np.int64), "u": ends[0], "v": ends[1]})

    return run


def near_blocks(laid: space.Blocks, bounds: DataFrame, most: int, floor: int, fan: int = space.FAN, direct: int = space.DIRECT) -> DataFrame:
    """(i, j): blocks, i <= j, whose points may have to be joined. bounds: with ``least`` and ``largest``, the ends of the labels."""
    names = laid.columns + laid.pivots
    near, far = space.nearest(laid.columns, laid.pivots), space.farthest_apart(laid.columns, laid.pivots)
    one = (F.col("i_least") == F.col("i_largest")) & (F.col("j_least") == F.col("j_largest"))

    def keep(pairs: DataFrame) -> DataFrame:
        return pairs.where((F.col("i") <= F.col("j")) & (near <= most) & ((F.col("i") == F.col("j")) | ~(one & (F.col("i_least") == F.col("j_least")))))

    ends = [F.min("least").alias("least"), F.max("largest").alias("largest")]
    found = space.descend(bounds, bounds, (laid.count, laid.count), names, keep, ends, ["least", "largest"], fan, direct)
    found = found.select("i", "j", near.alias("near"), far.alias("far"), one.alias("one"), F.least("i_least", "j_least").alias("u"), F.greatest("i_least", "j_least").alias("v"))
    found = cut(found, "near") if laid.count > direct else found  # few pairs are cheaper to find again
    # of two components, no pair of blocks farther apart than another pair's largest distance
    bound = found.where("one and i < j").groupBy("u", "v").agg(F.min(F.struct("far", "i", "j")).alias("least"))
    settled = found.where("one and i < j").join(bound, ["u", "v"]).where((F.col("near") <= F.greatest("least.far", F.lit(floor))) & ((F.col("least.far") > floor) | ((F.col("i") == F.col("least.i")) & (F.col("j") == F.col("least.j")))))
    return found.where("not (one and i < j)").select("i", "j").unionByName(settled.select("i", "j"))


def candidates(laid: space.Blocks, most: int, floor: int = 0, label: str | None = None, fan: int = space.FAN, direct: int = space.DIRECT) -> DataFrame:
    """(a, b, d2): edges that hold a minimum spanning forest of the points' distances up to ``most``, between components if ``label`` names them.

    Without ``label`` cells of the floor are the components to start with, and the edges that hold them together are given as well.
    """
    links = label is None
    mark = label or ("place" if laid.celled and floor >= len(laid.columns) else None)
    rows = laid.rows.select("event_id", *laid.columns, "block", *([mark] if mark else []))
    run = _spanned(laid.columns, most, floor, mark, links)
    if laid.bounds is None:
        return rows.groupBy("block").applyInPandas(run, EDGES)
    ends = laid.bounds
    if label:
        ends = cut(ends.join(laid.rows.groupBy("block").agg(F.min(label).alias("least"), F.max(label).alias("largest")), "block"), "bounds")
    else:
        ends = ends.withColumns({"least": F.col("first") if mark else F.lit(0), "largest": F.col("last") if mark else F.lit(1)})
    pairs = near_blocks(laid, ends, most, floor, fan, direct)
    if label:  # nothing to join inside a block of one component
        pairs = pairs.join(ends.where("least = largest").select(F.col("block").alias("i"), F.col("block").alias("j")), ["i", "j"], "left_anti")
    if laid.count > direct:
        found = balance.each_pair(rows, *balance.dealt(pairs, space.cost(laid)), run, EDGES)
    else:
        sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
        found = rows.join(sides, "block").groupBy("i", "j").applyInPandas(run, EDGES)
    if links and mark:  # a cell that goes on in the next block
        after = laid.bounds.select((F.col("block") - 1).alias("block"), F.col("first").alias("last"), F.col("head").alias("b"))
        more = laid.bounds.select("block", "last", F.col("tail").alias("a")).join(after, ["block", "last"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(floor).cast("long").alias("d2"))
        found = found.unionByName(more.withColumns({"u": F.col("a"), "v": F.col("b")}))
    return found


def spanning_forest(found: DataFrame, few: int) -> DataFrame:
    """The minimum spanning forest of edges (a, b, d2, u, v): Borůvka rounds until at most ``few`` edges are left, which one task finishes.

    In a round every component takes its least edge (ties by a, b), components joined by these are contracted, and of
    parallel edges the least stays. Rounds at least halve the components.
    """
    rest = cut(local_forests(found).select("*", F.col("u").alias("x"), F.col("v").alias("y")), "edges")
    kept: DataFrame | None = None
    names = ["a", "b", "d2", "u", "v"]
    while True:
        if rest.count() <= few:
            last = rest.coalesce(1).mapInPandas(_contracted_forest, EDGES)
            return last if kept is None else kept.unionByName(last)
        least = F.min(F.struct("d2", "a", "b", "u", "v")).alias("e")
        ends = rest.select("x", *names).unionByName(rest.select(F.col("y").alias("x"), *names))
        taken = cut(ends.groupBy("x").agg(least).select("e.*").distinct().join(rest, names).select(*names, "x", "y").distinct(), "taken")
        kept = taken.select(*names) if kept is None else kept.unionByName(taken.select(*names))
        to = cut(connected_components(taken, "x", "y"), "contracted")
        moved = rest
        for c in ("x", "y"):
            moved = moved.join(to.select(F.col("id").alias(c), F.col("comp").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        moved = moved.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(least)
        rest = cut(moved.select("e.*", "x", "y"), "edges")


def _contracted_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["a", "b", "d2", "u", "v"]
    x = pd.concat([pd.DataFrame({c: [] for c in (*names, "x", "y")}).astype("int64"), *batches], ignore_index=True)
    yield x.iloc[forest_of(x["x"].to_numpy(), x["y"].to_numpy(), x["d2"].to_numpy())][names] if len(x) else x[names]


def minimum_forest(points: DataFrame, most: int, floor: int = 0, rows: int = space.BLOCK, few: int = 1_000_000, fan: int = space.FAN, direct: int = space.DIRECT) -> DataFrame:
    """The minimum spanning forest (a, b, d2) of points (event_id, c*), of squared distances up to ``most``; weights up to ``floor`` are as they come."""
    return spanning_forest(candidates(space.lay(points, floor, rows), most, floor, None, fan, direct), few).select("a", "b", "d2")
