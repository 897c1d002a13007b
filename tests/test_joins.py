"""Joins by distance: what they send, and their pairs on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epsforest.operators import balance
from epsforest.operators import neighbors as nb


def brute(rows, t, label=None):
    """Sorted (a, b, d2) of rows (event_id, c0 .., mark) as the SQL has them: a < b, no row with a null."""
    rows = [r for r in rows if None not in r]
    ids, mark, x = np.array([r[0] for r in rows]), np.array([r[-1] for r in rows]), np.array([r[1:-1] for r in rows], dtype=np.int64)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    a, b = np.nonzero((d2 <= t) & (ids[:, None] < ids[None]) & ((mark[:, None] != mark[None]) | (label is None)))
    return sorted(zip(ids[a].tolist(), ids[b].tolist(), d2[a, b].tolist()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, " + "".join(f"c{k} int, " for k in range(len(rows[0]) - 2)) + "mark int").repartition(3)


def found(df):
    return sorted(map(tuple, df.select("a", "b", "d2").collect()))


def test_rows_are_sent_for_tiles_not_for_pairs_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, *map(int, r), 0) for i, r in enumerate(rng.integers(0, 50, (1200, 20)))]  # all near each other: every pair of 150 blocks meets
    placed, sent = balance.each_pair, []

    def each_pair(rows, pairs, *rest):
        sent.append(rows.join(pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), "block").count())
        return placed(rows, pairs, *rest)

    monkeypatch.setattr(balance, "each_pair", each_pair)
    t = 4500
    assert found(nb.block_pairs(frame(spark, rows), t, block_rows=16)) == brute(rows, t)
    assert len(sent) == 1 and sent[0] <= 16 * len(rows)  # a copy for each pair of blocks: 150


@pytest.mark.parametrize(("columns", "scale", "side"), [(2, 1, 32), (20, 1, 32), (20, 2000, 10**6)])
def test_tiles_on_odd_rows(spark, monkeypatch, columns, scale, side):
    monkeypatch.setattr(nb, "TILE_ROWS", side)
    monkeypatch.setattr(nb, "STRIP", 24)
    monkeypatch.setattr(nb, "CHUNK", 10)
    rng = np.random.default_rng(columns)
    centres = rng.integers(0, 60, (9, columns))
    x = (centres[rng.integers(0, 9, 260)] + rng.integers(0, 8, (260, columns))) * scale
    rows = [(i, *map(int, r), i % 3) for i, r in enumerate(x)]
    rows += [(5, *rows[9][1:]), (5, *rows[5][1:]), (900, *rows[9][1:])]  # a repeated id, copies
    points = frame(spark, [*rows, (None, *rows[7][1:]), (901, None, *rows[8][2:]), (902, *[None] * columns, 1)])
    t = 20 * columns * scale * scale
    want = brute(rows, t)
    assert len(want) > 100
    assert found(nb.block_pairs(points, t, block_rows=8)) == want
    assert found(nb.block_pairs(points, t, "mark", block_rows=20, tasks=3)) == brute(rows, t, "mark")
    assert found(nb.block_pairs(points, t)) == want  # a single block


def test_parts_that_may_be_near():
    rng = np.random.default_rng(5)
    points = np.repeat(rng.integers(0, 100, (30, 3)), 6, axis=0) + rng.integers(0, 9, (180, 3))
    pivots = np.floor(np.sqrt(((points[:, None] - points[None, [0, 90]]) ** 2).sum(axis=2)))
    near = nb._near_parts(np.hstack([points, pivots]).astype(float), np.arange(0, 180, 6), 3, 400)
    d2 = ((points[:, None] - points[None]) ** 2).sum(axis=2).reshape(30, 6, 30, 6).min(axis=(1, 3))
    assert near[d2 <= 400].all() and near.mean() < 0.3


def test_copies_are_joined_as_bundles(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, *map(int, r), 0) for i, r in enumerate(rng.integers(0, 10, (2000, 2)))]  # 100 vectors
    within, joined = nb.within, []

    def counted(*args, **kwargs):
        out = within(*args, **kwargs)
        joined.append(out.count())
        return out

    monkeypatch.setattr(nb, "within", counted)
    want = brute(rows, 2)
    assert found(nb.edges(frame(spark, rows), 2)) == want
    assert len(joined) == 1 and joined[0] < len(want) / 100  # a row for each pair of copies: len(want)


@pytest.mark.parametrize("copies", [0, 10**9])
def test_bundles_on_odd_rows(spark, monkeypatch, copies):
    monkeypatch.setattr(nb, "COPIES", copies)
    monkeypatch.setattr(nb, "PACK", 3)
    monkeypatch.setattr(nb, "PACKS", 2)
    rng = np.random.default_rng(13)
    rows = [(i, *map(int, r), i % 3) for i, r in enumerate(rng.integers(0, 14, (300, 2)))] + [(1000 + i, 5, 5, i % 2) for i in range(40)]
    rows += [(5, *rows[9][1:]), (5, *rows[5][1:]), (7, rows[7][1] + 1, *rows[7][2:]), (7, *rows[7][1:])]  # repeated ids, on equal and on near vectors
    points = frame(spark, [*rows, (None, *rows[7][1:]), (None, 5, 5, 1), (901, None, 3, 0), (902, None, 3, 1), (903, None, None, 1)])
    for t in (2, 9):
        assert found(nb.edges(points, t)) == brute(rows, t)
        assert found(nb.edges(points, t, "mark")) == brute(rows, t, "mark")
    got = nb.edges(points.where("event_id < 0"), 2)
    assert got.count() == 0 and got.columns == ["a", "b", "d2"]
