"""Pairs of points within a squared distance: a grid equi-join for few columns, of bundles of copies where there are many; blocks of pairs for many columns."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from epsforest.functions.points import columns_of, squared_distance
from epsforest.operators import balance, space
from epsforest.runtime import cut

GRID_COLUMNS, BLOCK_ROWS = 3, 4096
#: Rows that share a row's vector, on average, from which on copies are joined as bundles; packs of a bundle and ids of a pack at most; squared copies for a task.
COPIES, PACKS, PACK, SQUARES = 8, 16, 64, 1 << 22
#: Rows that are compared with so many others at a time; columns after which pairs that are too far are left out, if no more than this share is left.
CHUNK, STRIP, COLUMNS, FEW_LEFT = 256, 4096, 32, 0.1
#: Rows and blocks of one side of a tile at most.
TILE_ROWS, TILE_BLOCKS = 16384, 512


def collapse(points: DataFrame) -> DataFrame:
    """Equal vectors as one row: the smallest event_id and ``weight``, how many there are."""
    cols = columns_of(points)
    return points.groupBy(*cols).agg(F.min("event_id").alias("event_id"), F.count("*").alias("weight")).select("event_id", *cols, "weight")


def _facts(points: DataFrame) -> Row:
    """Least and largest of each column, the number of points, and the sum of squares of how many share a vector; one aggregation."""
    cols = columns_of(points)
    vectors = points.groupBy(*cols).agg(F.count("*").cast("double").alias("n"))
    return vectors.agg(*(f(c).alias(f"{n}{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")).first()


def grid_columns(points: DataFrame, t: int, facts: Row | None = None) -> list[str]:
    """Up to GRID_COLUMNS columns that cells of the needed width cut most often."""
    cols, bounds = columns_of(points), facts or _facts(points)
    width = isqrt(t) + 1
    cells = {c: ((bounds[f"hi{c}"] or 0) - (bounds[f"lo{c}"] or 0)) // width + 1 for c in cols}
    chosen = sorted((c for c in cols if cells[c] > 3), key=lambda c: -cells[c])[:GRID_COLUMNS]
    return chosen


def _cells(columns: list[str], width: int, shift: Column | None = None) -> list[Column]:
    return [(F.expr(f"{c} div {width}") + (shift[k] if shift is not None else 0)).cast("int").alias(f"g{k}") for k, c in enumerate(columns)]


def _offsets(columns: int) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for _ in range(columns):
        out = [[*o, d] for o in out for d in (-1, 0, 1)]
    return out


def within(left: DataFrame, right: DataFrame, t: int, by: list[str], extra: Column | None = None, half: bool = False, itself: bool = False) -> DataFrame:
    """``(l.*, r.*, d2)`` of all pairs with d2 <= t: left rows meet right rows of the neighbouring cells of ``by``.

    left's columns are prefixed ``l_``, right's ``r_``. Any two points within the distance differ by less than a cell's
    width in every column, so neighbouring cells are all that is needed; the exact distance is checked in the join. With
    ``half``, for a table with itself, each pair of rows comes once: only half of the neighbours are visited, and in
    the own cell only larger ids, and with ``itself`` each row with itself.
    """
    if not by:  # one cell: dealt as blocks by the caller
        raise ValueError("no column to cut")
    width, cols = isqrt(t) + 1, columns_of(left)
    offsets = [o for o in _offsets(len(by)) if not half or o >= [0] * len(by)]
    near = F.explode(F.array(*(F.array(*map(F.lit, o)) for o in offsets)))
    names = [f"g{k}" for k in range(len(by))]
    l = left.select("*", *_cells(by, width)).select(*(F.col(c).alias(f"l_{c}") for c in left.columns), *names)  # noqa: E741
    own = F.forall("_o", lambda x: x == 0)
    r = right.withColumn("_o", near).select("*", own.alias("own"), *_cells(by, width, F.col("_o"))).select(*(F.col(c).alias(f"r_{c}") for c in right.columns), "own", *names)
    d2 = squared_distance("l_", "r_", cols)
    on = d2 <= t
    on = on & extra if extra is not None else on
    after = F.col("l_event_id") <= F.col("r_event_id") if itself else F.col("l_event_id") < F.col("r_event_id")
    on = on & (~F.col("own") | after) if half else on
    return l.join(r, names).where(on).withColumn("d2", d2).drop("own", *names)


def _near_parts(x: np.ndarray, starts: np.ndarray, width: int, t: int) -> np.ndarray:
    """Whether two parts may hold rows within t, for all pairs of parts: by the box of their first ``width`` columns, and by the others, which are distances to pivots."""
    lo, hi = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    box, ok = np.zeros((len(starts), len(starts))), True
    for k in range(x.shape[1]):
        gap = np.maximum(0, np.maximum(lo[None, :, k] - hi[:, None, k], lo[:, None, k] - hi[None, :, k]))
        if k < width:
            box += gap * gap
        else:  # rounded down, so two of them may be nearer by less than one
            ok &= np.maximum(0, gap - 1) ** 2 <= t
    return ok & (box <= t)


def _compared(width: int, t: int, label: str | None):
    """Edges of one tile, a frame for each strip of a chunk: rows of a group of blocks with themselves, or of two groups with each other."""

    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values(["block", "part"], kind="stable")
        own, part, ids = rows["block"].to_numpy(), rows["part"].to_numpy(), rows["event_id"].to_numpy(np.int64)
        x = np.stack(rows["v"].to_list()).astype(np.float64)
        mark = rows[label].to_numpy() if label else None
        first = int((own == own[0]).sum())
        same = first == len(own)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(part)]))
        near, x = _near_parts(x, starts, width, t), np.ascontiguousarray(x[:, :width])
        for lo in range(0, first, CHUNK):
            end = min(lo + CHUNK, first)
            meets = near[place[lo] : place[end - 1] + 1].any(axis=0)
            others = np.arange(lo if same else first, len(own))
            others = others[meets[place[others]]]
            for at in range(0, len(others), STRIP):
                v = others[at : at + STRIP]
                a, b = _within(x[lo:end], x[v], t)
                a, b = a + lo, v[b]
                keep = ids[a] != ids[b]
                if same:
                    keep &= a < b
                if label:
                    keep &= mark[a] != mark[b]
                a, b = a[keep], b[keep]
                d = x[a] - x[b]
                yield pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "d2": (d * d).sum(axis=1).astype(np.int64)})

    return run


def _within(x: np.ndarray, y: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of rows within t: after each COLUMNS columns pairs that are too far already are left out, once few are left."""
    near = None
    total = np.zeros((len(x), len(y)))
    for lo in range(0, x.shape[1], COLUMNS):
        p, q = x[:, lo : lo + COLUMNS], y[:, lo : lo + COLUMNS]
        if near is None:  # products of whole numbers are exact in floats below 2**53
            total += (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None] - 2 * (p @ q.T)
            ok = total <= t
            if ok.mean() < FEW_LEFT:
                near, total = np.nonzero(ok), total[ok]
        else:
            d = p[near[0]] - q[near[1]]
            total = total + (d * d).sum(axis=1)
            ok = total <= t
            near, total = (near[0][ok], near[1][ok]), total[ok]
    return np.nonzero(total <= t) if near is None else near


def _meeting(laid: space.Blocks, t: int) -> DataFrame:
    """Pairs (i, j) of blocks, i <= j, that may hold points within t."""
    near = space.nearest(laid.columns, laid.pivots)
    keep = lambda pairs: pairs.where((F.col("i") <= F.col("j")) & (near <= t))
    return space.descend(laid.bounds, laid.bounds, (laid.count, laid.count), laid.columns + laid.pivots, keep).select("i", "j")


def _near_blocks(points: DataFrame, t: int, block_rows: int, label: str | None = None) -> tuple[space.Blocks, DataFrame]:
    laid = space.lay(points.select("event_id", *columns_of(points), *([label] if label else [])), rows=max(1, block_rows // 2))
    if laid.bounds is None:
        return laid, points.sparkSession.createDataFrame([(0, 0)], "i int, j int")
    pairs = _meeting(laid, t)
    return laid, cut(pairs, "pairs") if laid.count > space.DIRECT else pairs


def _tiled(laid: space.Blocks, wanted: int) -> space.Blocks:
    """laid in groups of blocks as large as a tile's side may be, or smaller, so that there are several tiles for each of the wanted tasks."""
    by = min(TILE_ROWS // laid.rows_each, TILE_BLOCKS, laid.count // (isqrt(8 * wanted) + 1))
    return space.coarser(laid, max(1, by))


def block_pairs(points: DataFrame, t: int, label: str | None = None, block_rows: int = BLOCK_ROWS, tasks: int | None = None) -> DataFrame:
    """(a, b, d2) by comparing blocks of rows with numpy; for many columns, where a grid cuts nothing.

    Blocks hold up to ``block_rows`` rows of one pivot at like distances (two of them, if not a single one); two meet only if the triangle inequality
    and their boxes leave room for a pair. What travels are not pairs of blocks but tiles, pairs of groups of up to TILE_BLOCKS blocks and TILE_ROWS rows:
    a row is sent once for each tile of its group, and a task finds out which of a tile's blocks meet. Tiles are dealt by cost to ``tasks`` tasks,
    or to as many as they need. Rows without an id or a value are near none.
    """
    names = columns_of(points)
    laid = space.lay(points.select("event_id", *names, *([label] if label else [])).dropna(subset=["event_id", *names]), rows=max(1, block_rows // 2))
    spark, kind = points.sparkSession, "long"
    if laid.bounds is None:
        rows, pairs, number = laid.rows.withColumn("part", F.lit(0)), spark.createDataFrame([(0, 0, 0)], "i int, j int, task int"), 1
    else:
        all_names = laid.columns + laid.pivots
        laid = _tiled(laid, tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
        ends = laid.bounds.agg(F.min(F.least(*(f"lo_{c}" for c in all_names), F.lit(0))), F.max(F.greatest(*(f"hi_{c}" for c in all_names), F.lit(0)))).first()
        kind = "smallint" if -(1 << 15) <= ends[0] and ends[1] < 1 << 15 else kind
        rows, (pairs, number) = laid.rows, balance.dealt(_meeting(laid, t), space.cost(laid), tasks)
    values = F.array(*(F.col(c).cast(kind) for c in laid.columns + laid.pivots)).alias("v")
    rows = rows.select("event_id", "block", "part", values, *([label] if label else []))
    return balance.each_pair(rows, pairs, number, _compared(len(names), t, label), "a long, b long, d2 long")


def compared_share(points: DataFrame, t: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """blocks, compared (pairs of blocks that meet), all (pairs that there are), of a join at ``t``."""
    laid, pairs = _near_blocks(points, t, block_rows)
    return pairs.agg(F.lit(laid.count).alias("blocks"), F.count("*").alias("compared"), F.lit(laid.count * (laid.count + 1) // 2).alias("all"))


def _bundles(points: DataFrame, also: list[str]) -> DataFrame:
    """Points that share a vector (and ``also``) as bundles: event_id, a bundle's number, c*, ``packs``, arrays of ids. However many share one, a task sorts only its part of them."""
    by = [*columns_of(points), *also]
    placed = points.dropna(subset=["event_id"]).repartitionByRange(*by, "event_id").sortWithinPartitions(*by, "event_id").withColumn("_at", F.monotonically_increasing_id())
    bundles = placed.groupBy(*by, F.expr(f"_at div {PACKS * PACK}").alias("_bundle")).agg(F.min("_at").alias("event_id"), F.collect_list("event_id").alias("ids"))
    packs = F.expr(f"transform(sequence(0, (size(ids) - 1) div {PACK}), k -> slice(ids, k * {PACK} + 1, {PACK}))").alias("packs")
    return cut(bundles.select("event_id", *by, packs), "bundles")


def _edges_of_bundles(points: DataFrame, t: int, by: list[str], label: str | None, tasks: int) -> DataFrame:
    """The grid join of bundles; each pair of bundles is dealt to one of ``tasks`` tasks, which makes its pairs of ids."""
    bundles = _bundles(points, [label] if label else [])
    extra = F.col(f"l_{label}") != F.col(f"r_{label}") if label else None
    pairs = within(bundles, bundles, t, by, extra, half=True, itself=True).select("l_event_id", "r_event_id", "l_packs", "r_packs", "d2").repartition(tasks, "l_event_id", "r_event_id")
    same = (F.col("l_event_id") == F.col("r_event_id")).alias("same")
    packs = pairs.select(same, "r_packs", "d2", F.explode("l_packs").alias("l")).select("same", "d2", "l", F.explode("r_packs").alias("r"))
    # generated loops hold all that a row becomes; the sort ends them, so that is a pair of packs and not of bundles
    each = packs.sortWithinPartitions("d2").select("same", "d2", "r", F.explode("l").alias("l")).select("same", "d2", "l", F.explode("r").alias("r"))
    return each.where("l < r or l > r and not same").select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "d2")


def edges(points: DataFrame, t: int, label: str | None = None, strategy: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, d2) with a < b and d2 <= t. ``label``: a column; pairs that share its value are left out."""
    facts = _facts(points) if strategy != "blocks" else None
    by = grid_columns(points, t, facts) if facts else []
    if not by or strategy == "blocks":
        return block_pairs(points, t, label, block_rows)
    if facts["squares"] >= COPIES * facts["n"]:
        return _edges_of_bundles(points, t, by, label, max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(facts["squares"] // SQUARES)))
    extra = F.col(f"l_{label}") != F.col(f"r_{label}") if label else None
    found = within(points, points, t, by, extra, half=True).where("l_event_id <> r_event_id")
    return found.select(F.least("l_event_id", "r_event_id").alias("a"), F.greatest("l_event_id", "r_event_id").alias("b"), "d2")


def degrees(found: DataFrame) -> DataFrame:
    """event_id, degree of every event with a neighbour."""
    ends = found.select(F.col("a").alias("event_id")).unionAll(found.select(F.col("b").alias("event_id")))
    return ends.groupBy("event_id").agg(F.count("*").alias("degree"))
