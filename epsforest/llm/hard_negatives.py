"""Hard negatives by a pivot table over vectors that turn inner products into Euclidean distances.

Rows get one more component, the root of the largest squared norm less their own, and anchors a zero there; then the
squared distance of an anchor and a row is ``|anchor|^2 + most - 2 * score``, and a large score is a small distance. A few
pivots are chosen far apart in a bounded sample, and every row stores its distances to all of them. By the triangle
inequality, the distances of an anchor and of a set of rows to a pivot bracket their distance, and so their score.

Rows are ordered by their nearest pivot and the distance to it and dealt to buckets of BUCKET rows; anchors are dealt to
blocks of ANCHORS in the same order. A search asks, for each anchor and slot, for the first k scores in a range. It first
looks into the anchor's own bucket, which seeds the least score worth having; then a bucket meets a block only if their brackets
leave room for such a score, and inside, parts of PART rows whose bracket leaves none are skipped. What survives is checked
exactly: integers below 2**53 multiply exactly in floats. No bound drops a row that could belong to the result.

The first search finds each anchor's positives (same label, other row), the second, for each positive a slot, the negatives
(another label, a score between ``low`` and ``high`` percent of the positive's).

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do rows
whose integer components are so large (a squared norm of 2**52 or more) that scores would not be exact. A shorter vector
counts as filled up with zeros. Every row is a row of its own, also one that repeats an id; equal scores and ids are
equal in all that is returned. Anchors without positives, and positives without negatives, have no row. Other columns
are not used. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epsforest.operators.ranking import global_rank
from epsforest.runtime import cut

PIVOTS, SAMPLE = 8, 2048
BUCKET, ANCHORS, PART = 4096, 512, 128
#: Scores are smaller than this; distances are widened by a share that rounding stays far below.
FAR, SLACK = 2**52, 1e-9


def integer_rows(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, v): floor(256 * x) of each component, of the rows that take part."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * 256))
    fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**18))
    rows = df.where(F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.coalesce(fit, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm", norm).where(F.col("norm") < float(FAR)).select("vec_id", "label", F.transform("v", lambda c: c.cast("int")).alias("v"), F.col("norm").cast("long").alias("norm"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` floats, shorter lists filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the augmented sample, each the farthest from those before."""
    rows = np.hstack([sample, np.sqrt(np.maximum(0, most - (sample * sample).sum(axis=1)))[:, None]])
    chosen = [0]
    near = np.full(len(rows), np.inf)
    for _ in range(min(PIVOTS, len(rows)) - 1):
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    return rows[chosen]


def _distances(pivots: np.ndarray, width: int, most: int):
    """Adds each row's distances to the pivots, as a row and as an anchor (whose further component is zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            norm = batch.column("norm").to_numpy().astype(np.float64)
            last = np.sqrt(np.maximum(0, most - norm))
            inner, base = v @ pivots[:, :-1].T, norm[:, None] + (pivots * pivots).sum(axis=1)
            row = np.sqrt(np.maximum(0, base + (last**2)[:, None] - 2 * (inner + last[:, None] * pivots[:, -1])))
            anchor = np.sqrt(np.maximum(0, base - 2 * inner))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(pivots)).cast(pa.list_(pa.float64())) for x in (row, anchor)]
            cell = row.argmin(axis=1)
            columns = [*batch.columns, *lists, pa.array(cell.astype(np.int32)), pa.array(row[np.arange(len(row)), cell])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "to_row", "to_anchor", "cell", "far"])

    return run


def _bounds(df: DataFrame, by: str, distances: str, pivots: int, prefix: str, *more: Column) -> DataFrame:
    """A row a group: the least and largest distance to each pivot."""
    ends = [f(F.get(distances, k)).alias(f"{prefix}{n}{k}") for k in range(pivots) for n, f in (("lo", F.min), ("hi", F.max))]
    return df.groupBy(by).agg(*ends, *more)


def _gap(lo: np.ndarray, hi: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest distance (anchors x parts) that distances to pivots leave: lo, hi of parts, ``to`` of anchors."""
    near = np.maximum(lo[None] - to[:, None], to[:, None] - hi[None]).max(axis=2)
    return np.maximum(near, 0) * (1 - SLACK), (hi[None] + to[:, None]).min(axis=2) * (1 + SLACK)


def _best(score: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the first k allowed scores of each anchor: larger first, ties by smaller id."""
    held = np.where(ok, score, -np.inf)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        ok = ok & (held >= least[:, None])
    a, r = np.nonzero(ok)
    order = np.lexsort((ids[r], -score[a, r], a))
    a, r = a[order], r[order]
    first = np.searchsorted(a, a, "left")
    keep = np.arange(len(a)) - first < k
    return a[keep], r[keep]


FOUND = "anchor long, slot int, vec_id long, score long"


def _search(rows: DataFrame, anchors: DataFrame, keys: list[str], width: int, most: int, k: int, same: bool) -> DataFrame:
    """FOUND of the groups by ``keys``. rows: (row, vec_id, label, v, to_row); anchors: (row, label, v, norm, to_anchor, asks: array of (slot, lo, hi))."""

    def group(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("row", "ascending")])
            v, q = matrix(left.column("v"), width), matrix(right.column("v"), width)
            pivots = len(left.column("to_row")[0])
            to_row, to = matrix(left.column("to_row"), pivots), matrix(right.column("to_anchor"), pivots)
            row, ids, label = (left.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            anchor, kind, norm = (right.column(c).to_numpy() for c in ("row", "label", "norm"))
            asks = right.column("asks").to_pylist()
            slots = max(len(a) for a in asks)
            lo, hi = np.full((slots, len(q)), 1.0), np.full((slots, len(q)), 0.0)
            names = np.zeros((slots, len(q)), np.int32)
            for i, each in enumerate(asks):
                for s, ask in enumerate(each):
                    names[s, i], lo[s, i], hi[s, i] = ask["slot"], ask["lo"], ask["hi"]
            some = lo <= hi
            least, largest = np.where(some, lo, np.inf).min(axis=0), np.where(some, hi, -np.inf).max(axis=0)
            cuts = np.arange(0, len(v), PART)
            near, wide = _gap(np.minimum.reduceat(to_row, cuts), np.maximum.reduceat(to_row, cuts), to)
            top = (norm + most)[:, None].astype(np.float64)
            open_parts = ((top - near**2) / 2 * (1 + SLACK) + 1 >= least[:, None]) & ((top - wide**2) / 2 * (1 - SLACK) - 1 <= largest[:, None])
            score = np.full((len(q), len(v)), -np.inf)
            for p, c in enumerate(cuts):
                who = np.flatnonzero(open_parts[:, p])
                if len(who):
                    score[who, c : c + PART] = q[who] @ v[c : c + PART].T
            match = (kind[:, None] == label[None]) & (anchor[:, None] != row[None]) if same else kind[:, None] != label[None]
            match &= np.isfinite(score)
            for s in range(slots):
                a, r = _best(score, match & (score >= lo[s][:, None]) & (score <= hi[s][:, None]), ids, k)
                out.append((anchor[a], names[s][a], ids[r], score[a, r].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1].astype(np.int32)), pa.array(columns[2], pa.int64()), pa.array(columns[3])], ["anchor", "slot", "vec_id", "score"])

    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(group, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Table:
    """The pivot table of all rows: buckets in pivot order with their bounds, written once."""

    def __init__(self, rows: DataFrame, anchor: Column, bucket: int = BUCKET, block: int = ANCHORS) -> None:
        rows = cut(rows, "vectors")
        facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("norm"), F.lit(0)).alias("most"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
        self.n, self.most, self.width = facts["n"], facts["most"], max(1, facts["width"])
        if not self.n:
            return
        sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(SAMPLE).toArrow()
        pivots = choose_pivots(matrix(sample.column("v"), self.width), self.most)
        self.pivots = len(pivots)
        schema = "vec_id long, label long, v array<int>, norm long, to_row array<double>, to_anchor array<double>, cell int, far double"
        placed = rows.mapInArrow(_distances(pivots, self.width, self.most), schema)
        ranked = global_rank(placed, ["cell", "far", "vec_id"], "row").withColumn("bucket", F.expr(f"cast(row div {bucket} as int)"))
        self.rows = cut(ranked.drop("cell", "far"), "pivot-table")
        self.bounds = cut(_bounds(self.rows, "bucket", "to_row", self.pivots, "r"), "bounds")
        at = global_rank(self.rows.where(anchor).select("row", "label", "v", "norm", "to_anchor", "bucket"), ["row"], "place")
        self.anchors = cut(at.withColumn("block", F.expr(f"cast(place div {block} as int)")).drop("place"), "anchors")

    def search(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor, slot, vec_id, score, rank: the first k of what each ask (row, slot, lo, hi) may have."""
        entry = F.struct("slot", "lo", "hi")
        asked = self.anchors.join(asks.groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("asks")), "row")  # a few slots an anchor
        own = _search(self.rows, asked, ["bucket"], self.width, self.most, k, same)
        seeds = own.groupBy("anchor", "slot").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("anchor").alias("row"), "slot", "least")
        raised = asks.join(seeds, ["row", "slot"], "left").select("row", "slot", F.greatest("lo", F.coalesce("least", "lo")).alias("lo"), "hi")
        asked = cut(self.anchors.join(raised.groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("asks")), "row"), "asked")

        least, largest = F.min(F.array_min(F.transform("asks", lambda a: a["lo"]))), F.max(F.array_max(F.transform("asks", lambda a: a["hi"])))
        blocks = _bounds(asked, "block", "to_anchor", self.pivots, "a", F.max("norm").alias("norm"), F.min("norm").alias("small"), least.alias("least"), largest.alias("largest"))
        pairs = self._meet(blocks)
        near = F.greatest(F.lit(0.0), *(F.greatest(F.col(f"rlo{j}") - F.col(f"ahi{j}"), F.col(f"alo{j}") - F.col(f"rhi{j}")) for j in range(self.pivots))) * (1 - SLACK)
        wide = F.least(F.lit(1e300), *(F.col(f"rhi{j}") + F.col(f"ahi{j}") for j in range(self.pivots))) * (1 + SLACK)
        over = (F.col("norm") + self.most - near * near) / 2 * (1 + SLACK) + 1 >= F.col("least")
        under = (F.col("small") + self.most - wide * wide) / 2 * (1 - SLACK) - 1 <= F.col("largest")
        pairs = cut(pairs.where(over & under).select("bucket", "block"), "pairs")
        found = _search(self.rows.join(pairs, "bucket"), asked.drop("bucket").join(pairs, "block"), ["bucket", "block"], self.width, self.most, k, same)
        return _first(found, k)

    def _meet(self, blocks: DataFrame) -> DataFrame:
        """Bounds of all buckets with those of all blocks of the stated query set, a row for thousands of rows each."""
        last = blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
        return self.bounds.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(blocks, "block")


def mine(df: DataFrame, vec_id: str, vector: str, label: Column, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, bucket: int = BUCKET, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors (a condition on ``vec_id``)."""
    found = Table(integer_rows(df, vec_id, vector, label), anchor, bucket, block)
    if not found.n:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asks = found.anchors.select("row", F.lit(0).alias("slot"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"))
    mates = cut(found.search(asks, positives, True).select(F.col("anchor").alias("row"), F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole numbers: low * positive <= 100 * negative <= high * positive
    down = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    least, most = -down(f"-{low} * positive_score"), down(f"{high} * positive_score")
    asks = cut(mates.select("row", "slot", least.alias("lo"), most.alias("hi")).where("lo <= hi"), "asks")
    hard = found.search(asks, negatives, False).select(F.col("anchor").alias("row"), "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = found.rows.select("row", F.col("vec_id").alias("anchor_id"))
    return hard.join(mates, ["row", "slot"]).join(names, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
