"""Rules of the scan on small tables, and every driver query against DuckDB."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual

from epsforest.functions.points import MOST, out_of_range, rescale, validate
from epsforest.operators.assign import _both, near_pairs, nearest
from epsforest.operators.components import connected_components
from epsforest.operators.extract import extract, recluster
from epsforest.operators.forest import forest_of, spanning_forest
from epsforest.operators.neighbors import block_pairs, compared_share, edges
from epsforest.operators.scan import scan
from epsforest.operators.select import select, split
from epsforest.plans import catalogue
from epsforest.plans.pipeline import pipeline
from epsforest import cli
from epsforest.operators.extract import recluster_together, reclustered
from epsforest.runtime import cut
from epsforest.sources import formats
from epsforest.sources.formats import BinaryTable, read_csv, write_binary, write_split
from epsforest.streaming.score import score_stream, settle

DATA = "/root/testdata/sf0.001"


def line(spark, values, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v) for i, v in enumerate(values)], "event_id long, c0 int")


def labels(found):
    return {r["event_id"]: r["cluster"] for r in found.final_labels().collect()}


def test_two_runs_merge(spark):
    runs = [0, 1, 2, 3, 10, 11, 12, 13]  # within 1; both merge at 7
    found = scan(line(spark, runs), 1, 9, 2, min_events=3, stop_percent=1000, go_on_decrease=True)
    got = labels(found)
    assert {got[k] for k in range(4)} == {1} and {got[k] for k in range(4, 8)} == {2}


def test_three_way_merge_and_chain(spark):
    found = scan(line(spark, [0, 1, 2, 10, 11, 12, 20, 21, 22]), 1, 15, 7, min_events=3, stop_percent=1000, go_on_decrease=True)
    assert found.clusters().count() == 3  # all meet in one pass
    found = scan(line(spark, [0, 1, 2, 6, 7, 8, 20, 21, 22]), 1, 13, 4, min_events=3, stop_percent=1000, go_on_decrease=True)
    assert sorted(r["size"] for r in found.clusters().collect()) == [3, 3, 3]  # the joined pair is not chosen


def test_born_last_is_dropped_unless_asked(spark):
    points = line(spark, [0, 5, 10, 100, 105, 110])
    assert scan(points, 5, min_events=3).clusters().count() == 0
    assert scan(points, 5, min_events=3, compat=False).clusters().count() == 2


def test_threshold_is_inclusive(spark):
    points = line(spark, [0, 3, 7])
    assert edges(points, 9).count() == 1 and edges(points, 8).count() == 0 and edges(points, 16).count() == 3 - 1


def test_descending_keeps_the_first_distance(spark):
    runs = [0, 1, 2, 3, 10, 11, 12, 13]
    found = scan(line(spark, runs), 3, 1, 1, min_events=3, go_on_decrease=True)
    assert {r["comp"] for r in found.retained().collect()} == {0, 4}


def test_ambiguous_events_stay(spark):
    queries = line(spark, [5, 2, 100], [90, 91, 92])
    targets = spark.createDataFrame([(0, 0, 1), (1, 10, 2), (2, 4, 1)], "event_id long, c0 int, cluster int").where("event_id < 2")
    got = {r["event_id"]: r["cluster"] for r in nearest(queries, targets).collect()}
    assert got == {90: 0, 91: 1, 92: 2}
    same = spark.createDataFrame([(0, 0, 1), (1, 10, 1)], "event_id long, c0 int, cluster int")
    assert {r["event_id"]: r["cluster"] for r in nearest(queries, same, cutoff=25).collect()} == {90: 1, 91: 1}


@pytest.mark.parametrize("columns", [1, 2, 20])
def test_nearest_equals_brute_force(spark, columns):
    rng = np.random.default_rng(columns)
    centres = rng.integers(0, 300, (8, columns))
    x, y = (centres[rng.integers(0, 8, n)] + rng.integers(0, 12, (n, columns)) for n in (150, 260))
    cluster = rng.integers(1, 5, len(y))
    names = ", ".join(f"c{k} int" for k in range(columns))
    queries = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "event_id long, " + names).repartition(3)
    targets = spark.createDataFrame([(i, *map(int, r), int(c)) for i, (r, c) in enumerate(zip(y, cluster, strict=True))], f"event_id long, {names}, cluster int")
    d2 = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    found = [(i, int(d.min()), {*cluster[d == d.min()].tolist()}) for i, d in enumerate(d2)]
    want = {i: (d, c.pop() if len(c) == 1 else 0) for i, d, c in found}
    for cutoff, rows, direct in ((None, 16, 2), (None, 1024, 64), (int(np.median(d2.min(axis=1))), 16, 2)):
        got = {r["event_id"]: (r["d2"], r["cluster"]) for r in nearest(queries, targets, cutoff, rows, 2, direct).collect()}
        assert got == {i: v for i, v in want.items() if cutoff is None or v[0] <= cutoff}
    assert columns > 2 or any(c == 0 for _, c in want.values())  # ties
    laid = _both(queries, targets, 6)
    assert near_pairs(laid, None, 2, 2).count() < laid.count * laid.count / 4
    assert nearest(queries.limit(0), targets).count() == 0 and nearest(queries, targets.limit(0)).count() == 0


def test_sampling_and_flags(spark):
    rows = [(k, k % 2, k) for k in range(12)]
    points = spark.createDataFrame(rows, "event_id long, flag int, c0 int")
    kept = split(points, 3, "flag").where("not is_leftover").select("event_id").orderBy("event_id").collect()
    assert [r[0] for r in kept] == [1, 7]  # ranks 0 and 3 of 1, 3, 5, 7, 9, 11
    assert select(points.drop("flag")).leftover is None
    with pytest.raises(ValueError):
        split(points, 0)


def test_range(spark):
    good, bad = line(spark, [0, MOST]), line(spark, [0, MOST + 1, -1])
    assert validate(good).count() == 2 and out_of_range(bad).count() == 2
    with pytest.raises(PySparkException):
        validate(bad).collect()
    assert sorted(r["c0"] for r in rescale(line(spark, [5, 10, 15]), ["c0"]).collect()) == [0, 8191, 16383]


def test_edges_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 200, (300, 3))
    points = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "event_id long, c0 int, c1 int, c2 int")
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {(i, j, int(d2[i, j])) for i in range(300) for j in range(i + 1, 300) if d2[i, j] <= 400}
    for found in (edges(points, 400), block_pairs(points, 400, block_rows=70), block_pairs(points, 400, block_rows=7)):
        assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize(("columns", "spread"), [(20, 30), (70, 30), (70, 9)])
def test_wide_edges_equal_brute_force(spark, columns, spread):
    rng = np.random.default_rng(columns)
    centres = rng.integers(0, 900, (10, columns))
    x = centres[rng.integers(0, 10, 240)] + rng.integers(0, spread, (240, columns))
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    t = int(np.quantile(d2[d2 > 0], 0.05))
    names = ", ".join(f"c{k} int" for k in range(columns))
    points = spark.createDataFrame([(i, *map(int, r), i % 3) for i, r in enumerate(x)], f"event_id long, {names}, mark int")
    want = {(i, j, int(d2[i, j])) for i in range(240) for j in range(i + 1, 240) if d2[i, j] <= t}
    assert {tuple(r) for r in block_pairs(points, t, block_rows=12).collect()} == want
    assert {tuple(r) for r in block_pairs(points, t, "mark", block_rows=4096).collect()} == {e for e in want if e[0] % 3 != e[1] % 3}
    share = compared_share(points, t, 12).first()
    assert share["blocks"] == 40 and share["compared"] < share["all"] / 2


def test_edges_of_an_empty_table(spark):
    assert block_pairs(line(spark, [1, 2]).limit(0), 4).count() == 0


@pytest.mark.parametrize("parts", [1, 30])
def test_spanning_forest(spark, parts):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 80, (2, 900))
    rows = [(int(x), int(y), int(x + y) % 7) for x, y in zip(a, b, strict=True) if x < y]
    found = spark.createDataFrame(rows, "a long, b long, d2 long").withColumns({"u": F.col("a"), "v": F.col("b")}).repartition(parts)
    weights = sorted(np.array([r[2] for r in rows])[forest_of(*(np.array([r[k] for r in rows]) for k in range(3)))].tolist())
    for few in (0, 30, 10**6):  # all rounds distributed, some, none
        one = spanning_forest(found, few).toPandas()
        assert sorted(one["d2"].tolist()) == weights and len(one) < 80
    for t in (0, 3):
        comps = [{(r["id"], r["comp"]) for r in connected_components(x.where(F.col("d2") <= t)).collect()} for x in (found, spark.createDataFrame(one))]
        assert comps[0] == comps[1]


def test_missing_features_are_refused(spark):
    with pytest.raises(ValueError, match="features are missing in 1 events"):
        scan(line(spark, [1, None, 3]), 1, min_events=2)
    assert scan(line(spark, [1, 2]).limit(0), 1, min_events=2).final_labels().count() == 0


def test_components_and_forest(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    up = list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        up[max(root(x), root(y))] = min(root(x), root(y))
    found = connected_components(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long"))
    got = {r["id"]: r["comp"] for r in found.collect()}
    assert got == {int(k): root(int(k)) for k in {*a[a != b], *b[a != b]}}
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r["comp"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0
    assert len(forest_of(a[a != b], b[a != b], rng.integers(0, 9, int((a != b).sum())))) == 400 - len({root(k) for k in range(400)})


@pytest.mark.parametrize("seed", range(2))
def test_distributed_scan_is_the_same(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 6, (25, 2)) for c in ((40, 40), (60, 50), (120, 90))]).clip(0).astype(int)
    points = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "event_id long, c0 int, c1 int").repartition(3)
    one, other = (scan(points, 1, 9, 2, min_events=4, go_on_decrease=True, few=k, block_rows=11, few_blocks=0 if k else 99) for k in (10**6, 0))
    assert {tuple(r) for r in one.lineage().collect()} == {tuple(r) for r in other.lineage().collect()}
    births = one.lineage().where(F.col("birth") & (F.col("pass") < one.last_pass)).count()
    assert one.clusters().count() == births


def test_recluster_extract_and_run(spark):
    points = line(spark, [0, 1, 2, 3, 10, 11, 12, 13, 40, 45, 50, 300])
    run = pipeline(points, 1, 3, 2, min_events=3, sample_every=1)
    assert run.result.count() == 12
    with pytest.raises(ValueError):
        extract(points, run.labels, with_label=False)
    again = recluster(run.scan, run.labels, "unassigned", first=5, min_events=3, compat=False)[0]
    assert again.clusters().count() == 1
    parts = reclustered(spark, recluster(run.scan, run.labels, "clusters", first=1, min_events=3, compat=False)).collect()
    assert sorted(tuple(r) for r in parts) == [(1, k, 1) for k in range(4)] + [(2, k, 1) for k in range(4, 8)]
    once = recluster_together(run.scan, run.labels, 1, min_events=3, compat=False).collect()
    assert sorted(tuple(r) for r in once) == sorted(tuple(r) for r in parts)
    none = run.labels.withColumn("cluster", F.lit(0))
    assert recluster_together(run.scan, none, 1, min_events=3).count() == 0 and recluster(run.scan, none, "clusters") == {}
    timed = run.scan.report(timed=True).collect()
    assert all(r["seconds"] >= 0 and r["workers"] > 0 for r in timed) and len(timed) == run.scan.last_pass + 1


def test_files(spark, tmp_path):
    points = line(spark, [5, 6, 7]).withColumn("c1", F.lit(9))
    spark.dataSource.register(BinaryTable)
    for kind, df in (("selected", points), ("assigned", points.withColumn("cluster", F.lit(2)))):
        path = str(tmp_path / kind)
        assert write_binary(df.orderBy("event_id"), path, kind, "id,a,b") == 3
        back = spark.read.format("density_table").load(path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "x.csv").write_text("id,a\n1,5\n2,x\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv")).orderBy("event_id").collect()] == [(1, 5), (2, None)]


def test_binary_tables_written_by_tasks(spark, tmp_path, monkeypatch):
    spark.dataSource.register(BinaryTable)
    points = line(spark, list(range(100))).withColumn("cluster", F.col("event_id").cast("int") % 3).repartition(4)
    path = str(tmp_path / "folder")
    points.write.format("density_table").mode("append").option("kind", "assigned").save(path)
    back = spark.read.format("density_table").load(path)
    assert back.rdd.getNumPartitions() > 1 and sorted(map(tuple, back.collect())) == sorted(map(tuple, points.collect()))
    with pytest.raises(Exception, match="missing values"):
        points.withColumn("c0", F.lit(None).cast("int")).write.format("density_table").mode("append").option("kind", "assigned").save(path)
    assert spark.read.format("density_table").load(path).count() == 100


def test_selected_tables(spark, tmp_path, monkeypatch):
    spark.dataSource.register(BinaryTable)
    rng = np.random.default_rng(9)
    rows = [(int(i), int(rng.integers(0, 5)), int(rng.integers(0, 1000))) for i in rng.permutation(900)]
    (tmp_path / "a.csv").write_text("id,x,y\n" + "".join(f"{i},{x},{y}\n" for i, x, y in rows[:400]))
    (tmp_path / "b.csv").write_text("id,x,y\n" + "".join(f"{i},{x},{y}\n" for i, x, y in rows[400:]))
    monkeypatch.setattr(cli, "clear", lambda spark: None)
    for name in ("in", "out"):
        (tmp_path / name).mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).rename(tmp_path / "in" / name)
    out = str(tmp_path / "out" / "x")
    cli.main(["select", str(tmp_path / "in"), out, "-s", "3"])
    kept = sorted(rows[::3], key=lambda r: (r[2], r[1]))  # stable: ties in input order
    back = spark.read.format("density_table").load(out + ".selected")
    names = sorted(n for n in os.listdir(out + ".selected") if n[:1] not in "._")
    assert [tuple(r) for n in names for r in spark.read.format("density_table").load(f"{out}.selected/{n}").collect()] == kept
    assert sorted(map(tuple, spark.read.format("density_table").load(out + ".leftover").collect())) == sorted(r for k, r in enumerate(rows) if k % 3)
    back = formats.read_table(spark, out + ".selected")
    for where, ok in (("c1 >= 900", lambda y: y >= 900), ("c1 < 100", lambda y: y < 100), ("c1 = 7", lambda y: y == 7), ("c1 > 10 and c1 <= 20", lambda y: 10 < y <= 20), ("c1 in (5, 8)", lambda y: y in (5, 8)), ("c0 = 2", None)):
        got = sorted(map(tuple, back.where(where).collect()))
        assert got == sorted(r for r in kept if (ok(r[2]) if ok else r[1] == 2)), where
    reader = formats._FilteredReader(out + ".selected")
    assert list(reader.pushFilters([GreaterThanOrEqual(("c1",), 900)])) and 0 < sum(p.end - p.first for p in reader.partitions()) == sum(y >= 900 for _, _, y in kept) < len(kept) / 5
    monkeypatch.setattr(formats, "BATCH", 64)
    assert back.count() == len(kept)
    with pytest.raises(Exception, match="rescale"):
        (tmp_path / "in" / "c.csv").write_text("id,x,y\n5000,99999,1\n")
        cli.main(["select", str(tmp_path / "in"), out + "2"])
    cli.main(["select", str(tmp_path / "in"), out + "3", "-q", "-k", "1", "-s", "2"])


def test_split_and_cuts(spark, tmp_path):
    points = line(spark, [1, 2, 3])
    write_split(points, spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "event_id long, cluster int"), str(tmp_path / "x"))
    assert {r["event_id"] for r in spark.read.parquet(str(tmp_path / "x" / "assigned=true")).collect()} == {0, 2}
    a = cut(points, "some", by=["c0"])
    assert a.where("c0 = 2").drop("c0").collect() == [(1,)]


def test_command_line(spark, tmp_path, monkeypatch):
    values = [0, 1, 2, 3, 10, 11, 12, 13, 40, 45, 50, 300]
    (tmp_path / "x.csv").write_text("id,a\n" + "".join(f"{i},{v}\n" for i, v in enumerate(values)))
    name = lambda n: str(tmp_path / n)
    monkeypatch.setattr(cli, "clear", lambda spark: None)  # other tests' tables are in the same folder
    cli.main([name("x.csv"), name("out"), "-f", "1", "-l", "3", "-s", "2", "-n", "3", "-M", name("history"), "--passes", name("passes")])
    labels = {int(r["event_id"]): int(r["cluster"]) for r in spark.read.csv(name("out"), header=True).collect()}
    assert [labels[i] for i in range(12)] == [1] * 4 + [2] * 4 + [0] * 4
    assert spark.read.csv(name("history"), header=True).columns == ["pass", "dist", "cluster", "size", "descendfrom", "mergedto", "retain"]
    assert spark.read.parquet(name("passes")).where("pass = 0").count() == 12
    for args, want in (
        (["-c", "2"], [(4, 10, 2), (5, 11, 2), (6, 12, 2), (7, 13, 2)]), (["-c", "2", "-0"], [(4, 10), (5, 11), (6, 12), (7, 13)]),
        (["-c", "2", "-b"], [(4, 10, 1), (5, 11, 1), (6, 12, 1), (7, 13, 1)]), (["-u"], [(8, 40, 0), (9, 45, 0), (10, 50, 0), (11, 300, 0)]),
        (["-m"], [(2,)]), (["-s"], [(0, 4), (1, 4), (2, 4)]),
    ):
        out = name("e" + "".join(args))
        cli.main(["extract", name("x.csv"), name("out"), out, *args])
        assert sorted(tuple(map(int, r)) for r in spark.read.csv(out, header=True).collect()) == want
    with pytest.raises(SystemExit):
        cli.main(["extract", name("x.csv"), name("out"), name("no"), "-0"])
    cli.main([name("x.csv"), name("first"), "-f", "1", "-l", "1", "-n", "3", "--store", name("store")])
    cli.main([name("x.csv"), name("again"), "-f", "1", "-l", "3", "-s", "2", "-n", "3", "--store", name("store")])
    assert sorted(map(tuple, spark.read.csv(name("again"), header=True).collect())) == sorted(map(tuple, spark.read.csv(name("out"), header=True).collect()))
    cli.main([name("x.csv"), name("some"), "-f", "1", "-n", "2", "-L", "--sample-every", "2"])
    assert spark.read.csv(name("some.leftover.clusters")).count() == 6


def test_input_order(spark, tmp_path):
    ids = [9, 3, 7, 1, 8, 2, 6]
    (tmp_path / "x.csv").write_text("id,a\n" + "".join(f"{i},{i}\n" for i in ids))
    points = read_csv(spark, str(tmp_path / "x.csv"), ordered=True)
    assert [r["event_id"] for r in points.orderBy("position").collect()] == ids
    kept = select(points, 3, order="position").points
    assert {r["event_id"] for r in kept.collect()} == set(ids[::3])


def test_stream_scores_settle(spark):
    targets = spark.createDataFrame([(0, 0, 1), (1, 10, 2), (2, 100, 3)], "event_id long, c0 int, cluster int")
    events = spark.createDataFrame([(7, 5), (8, 2), (9, 99), (10, 60)], "event_id long, c0 int")
    near = score_stream(events, targets, cutoff=49)
    assert {r["event_id"]: r["cluster"] for r in settle(near).collect()} == {7: 0, 8: 1, 9: 3}


QUICK = ["eps_edges_cust2_dealt", "stream_components", "stream_components_by_time", "stream_scores", "recluster_clusters", "lineage_history", "split_by_assignment", "summary_by_category", "summary_table", "scan_pass_report", "scan_stops_when_assigned", "scan_stops_on_decrease", "sel_points_part2", "sel_column_stats", "sel_sort_key", "sel_flag_and_sample", "sel_sorted_rank", "eps_edges_cust2", "eps_edges_emb64", "components_part2", "scan_stats_cust2", "dedup_points_line3"]


@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("customer", "part", "lineitem", "embeddings", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
    rows = lambda x: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x)
    assert rows(got.select(*columns).collect()) == rows(want)
