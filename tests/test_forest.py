"""The space-partition tree, spanning forests and scans that don't fit a task, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epsforest.operators import forest as fo
from epsforest.operators import balance, space
from epsforest.operators import neighbors as nb
from epsforest.operators import scan as scans
from epsforest.operators.scan import resume, scan
from epsforest.sources.store import Store


def table(spark, x, parts=3):
    names = ", ".join(f"c{k} int" for k in range(x.shape[1]))
    return spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "event_id long, " + names).repartition(parts)


def weights(x, most):
    """Weights of the minimum spanning forest, edge by edge."""
    a, b = np.triu_indices(len(x), 1)
    d2 = ((x[a] - x[b]) ** 2).sum(axis=1)
    ok = d2 <= most
    return sorted(d2[ok][fo.forest_of(a[ok], b[ok], d2[ok])].tolist())


@pytest.mark.parametrize(("columns", "spread", "most"), [(1, 900, 400), (2, 150, 200), (3, 60, 10**6), (20, 40, 6000)])
def test_forest_weights_equal_brute_force(spark, columns, spread, most):
    rng = np.random.default_rng(columns)
    x = np.unique(rng.integers(0, spread, (260, columns)), axis=0)
    want = weights(x, most)
    points = table(spark, x)
    for few in (30, 10**6):
        assert sorted(r["d2"] for r in fo.minimum_forest(points, most, rows=16, few=few, fan=2, direct=4).collect()) == want
    floor = int(np.median(want)) if want else 0
    got = sorted(r["d2"] for r in fo.minimum_forest(points, most, floor, rows=16, fan=2, direct=4).collect())
    assert len(got) == len(want) and [d for d in got if d > floor] == [d for d in want if d > floor]


def test_forest_of_components(spark):
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 120, (200, 2)), axis=0)
    laid = space.lay(table(spark, x).withColumn("comp", F.col("event_id") % 9), rows=16)
    found = fo.spanning_forest(fo.candidates(laid, 900, label="comp", fan=2, direct=4), 4).toPandas()
    a, b = np.triu_indices(len(x), 1)
    d2 = ((x[a] - x[b]) ** 2).sum(axis=1)
    ok = (d2 <= 900) & (a % 9 != b % 9)
    want = d2[ok][fo.forest_of(a[ok] % 9, b[ok] % 9, d2[ok])]
    assert sorted(found["d2"]) == sorted(want.tolist()) and (found["u"] != found["v"]).all()


@pytest.mark.parametrize("columns", [2, 20])
def test_tree_keeps_all_near_pairs(spark, columns):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 400, (12, columns))
    x = np.unique(centres[rng.integers(0, 12, 400)] + rng.integers(-9, 10, (400, columns)), axis=0).clip(0)
    laid = space.lay(table(spark, x), rows=16)
    ends = laid.bounds.withColumns({"least": F.lit(0), "largest": F.lit(1)})
    kept = {(r["i"], r["j"]) for r in fo.near_blocks(laid, ends, 500, 0, fan=2, direct=4).collect()}
    block = {r["event_id"]: r["block"] for r in laid.rows.select("event_id", "block").collect()}
    a, b = np.nonzero(((x[:, None] - x[None]) ** 2).sum(axis=2) <= 500)
    assert {(min(block[i], block[j]), max(block[i], block[j])) for i, j in zip(a.tolist(), b.tolist(), strict=True)} <= kept
    blocks = len(set(block.values()))
    assert len(kept) < blocks * (blocks + 1) / 4  # below half of all pairs


def test_dense_cell_needs_no_pairs(spark):
    side = 320  # 102,400 distinct points within one distance of each other
    dense = spark.range(side * side).select(F.col("id").alias("event_id"), (F.col("id") % side).cast("int").alias("c0"), F.floor(F.col("id") / side).cast("int").alias("c1"))
    far = spark.createDataFrame([(10**6 + k, 5000 + 300 * k, 9000) for k in range(3)], "event_id long, c0 int, c1 int")
    points = dense.unionByName(far)
    found = scan(points, 330, min_events=2, compat=False, few_blocks=0)
    sizes = sorted(r["size"] for r in found.retained().collect())
    assert sizes == [3, side * side]
    laid = space.lay(points, 330 * 330 * 2)
    pairs = fo.near_blocks(laid, laid.bounds.withColumns({"least": F.col("first"), "largest": F.col("last")}), 330 * 330 * 2, 330 * 330 * 2)
    assert laid.count == 26 and pairs.where("i < j").count() < laid.count  # of 325


@pytest.mark.parametrize("few", [0, 40])
def test_scan_in_bands_of_blocks(spark, few):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 6, (40, 2)) for c in ((40, 40), (60, 50), (120, 90))] + [rng.uniform(0, 160, (60, 2))]).clip(0).astype(int)
    points = table(spark, x)
    options = {"min_events": 5, "go_on_decrease": True}
    one, other = scan(points, 1, 9, 2, **options), scan(points, 1, 9, 2, **options, few=few, block_rows=10, few_blocks=0)
    for result in ("lineage", "final_labels", "last_labels", "stats", "history"):
        assert sorted(map(repr, getattr(one, result)().collect())) == sorted(map(repr, getattr(other, result)().collect())), result
    for p in (0, one.last_pass):
        assert sorted(map(tuple, one.labels_at(p).collect())) == sorted(map(tuple, other.labels_at(p).collect()))


def test_storage_does_not_grow_with_passes(spark):
    rng = np.random.default_rng(6)
    alone = np.stack([np.arange(10) * 1000 + 3000] * 2, axis=1)  # so that the step never doubles
    points = table(spark, np.concatenate([*(rng.normal(c, 4, (50, 2)) for c in ((40, 40), (300, 50))), alone]).clip(0).astype(int))
    few, many = (scan(points, 8, 40, step, min_events=10, go_on_decrease=True, stop_percent=1000) for step in (16, 0.5))
    assert many.last_pass > 10 * few.last_pass
    assert many.nodes.count() <= few.nodes.count() + 20 and many.members.count() == few.members.count()


def test_a_vector_that_holds_most_events(spark):
    rows = [(i, 7, 7) for i in range(3000)] + [(4000 + i, 7 + 3 * i, 9) for i in range(30)]
    found = scan(spark.createDataFrame(rows, "event_id long, c0 int, c1 int"), 1, 5, 2, min_events=20, go_on_decrease=True, compat=False)
    labels = {r["event_id"]: r["cluster"] for r in found.final_labels().collect()}
    assert len(labels) == 3030 and {labels[i] for i in range(3000)} == {1}
    assert found.labels_at(0).where("comp = 0").count() >= 3000


def same(one, other):
    for result in ("lineage", "final_labels", "stats"):
        assert sorted(map(repr, getattr(one, result)().collect())) == sorted(map(repr, getattr(other, result)().collect())), result


def test_resumed_scans_equal_fresh_ones(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 6, (40, 2)) for c in ((40, 40), (60, 50), (120, 90))] + [rng.uniform(0, 160, (50, 2))]).clip(0).astype(int)
    points, bands = table(spark, x), {"block_rows": 16, "few_blocks": 0}
    path, rules = str(tmp_path / "store"), {"min_events": 5, "go_on_decrease": True}
    with pytest.raises(ValueError, match="no scan"):
        resume(Store(spark, path), 1)
    same(scan(points, 1, 5, 2, **rules, **bands, store=Store(spark, path)), scan(points, 1, 5, 2, **rules))
    with pytest.raises(ValueError, match="already"):
        scan(points, 1, store=Store(spark, path))
    with pytest.raises(ValueError, match="less than"):
        resume(Store(spark, path), 0.5)
    found, called = fo.candidates, []
    monkeypatch.setattr(fo, "candidates", lambda *a, **k: called.append(1) or found(*a, **k))
    other = {"min_events": 9, "stop_percent": 60, "go_on_decrease": True}
    same(resume(Store(spark, path), 1, 5, 1, **other, **bands), scan(points, 1, 5, 1, **other))
    assert len(called) == 1  # the fresh one's only
    # a run that dies while it looks for the next band leaves the store as it was
    monkeypatch.setattr(scans.fo, "candidates", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        resume(Store(spark, path), 1, 11, 2, **rules, **bands)
    monkeypatch.setattr(scans.fo, "candidates", found)
    before = len(Store(spark, path).manifest.bands)
    same(resume(Store(spark, path), 1, 11, 2, **rules, **bands), scan(points, 1, 11, 2, **rules))
    assert len(Store(spark, path).manifest.bands) > before


def test_pairs_are_dealt_by_cost(spark):
    # one dense cell, all of whose blocks meet, and far points whose blocks meet none
    rng = np.random.default_rng(8)
    x = np.unique(np.concatenate([rng.integers(0, 40, (700, 2)), rng.integers(0, 10**5, (330, 2))]), axis=0)
    points = table(spark, x)
    laid, pairs = nb._near_blocks(points, 3200, 64)
    known, number = balance.dealt(pairs, space.cost(laid), 8)
    loads = balance.loads(known).toPandas()
    assert number == len(loads) == 8 and loads["cost"].max() < 2 * loads["cost"].mean() and loads["pairs"].sum() == pairs.count()
    a, b = np.triu_indices(len(x), 1)
    want = {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if ((x[i] - x[j]) ** 2).sum() <= 3200}
    found = nb.block_pairs(points, 3200, block_rows=64, tasks=8)
    assert found.rdd.getNumPartitions() == 8
    assert {(r["a"], r["b"]) for r in found.collect()} == want
    assert balance.dealt(pairs.limit(0), space.cost(laid))[1] == 1
    # a single dear pair takes a task of its own, the others share the rest
    uneven = spark.createDataFrame([(0, 1, 100), *((k, k + 1, 10) for k in range(1, 41))], "i int, j int, w int")
    known, number = balance.dealt(uneven, F.col("w"), 50)
    loads = balance.loads(known).toPandas()
    assert number == 5 and loads["cost"].max() < 2 * loads["cost"].mean()


@pytest.mark.parametrize("size", [1, 3, 100])
def test_groups_of_a_sorted_partition(size):
    rows = pd.DataFrame([(i, j, k) for i in range(3) for j in range(i, 3) for k in range(4)], columns=["i", "j", "k"])
    batches = [rows.iloc[lo : lo + size] for lo in range(0, len(rows), size)] + [rows.iloc[:0]]
    got = list(balance._groups(lambda x: x)(iter(batches)))
    assert [len(x) for x in got] == [4] * 6 and pd.concat(got, ignore_index=True).equals(rows)
