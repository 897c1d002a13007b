"""Components of a stream against all pairs."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from epsforest.streaming import components as st

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, ts timestamp, c0 int, c1 int"


def plain(rows, t, horizon=None):
    """event_id to the smallest id of its component."""
    comp = {r[0]: r[0] for r in rows}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    whole = [r for r in rows if None not in r]
    for i, a in enumerate(whole):
        for b in whole[:i]:
            near = (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= t
            if near and (horizon is None or abs(a[1] - b[1]) <= timedelta(milliseconds=horizon)):
                x, y = sorted((top(a[0]), top(b[0])))
                comp[y] = x
    return {k: top(k) for k in comp}


def run(spark, folder, lots, t, horizon=None, **options):
    """Each lot arrives in a run of its own, which goes on from the checkpoint; the links, and how many rows the last run's states hold."""
    st.with_rocksdb(spark)
    for lot in lots:
        spark.createDataFrame(lot, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        query = st.write_links(st.link_stream(source, t, horizon, delay="1 second", **options), f"{folder}/links", f"{folder}/checkpoint")
        query.awaitTermination()
    return spark.read.schema(st.LINKS).parquet(f"{folder}/links"), query.recentProgress


def events(n, seed, spread=60):
    rng = np.random.default_rng(seed)
    return [(int(i), START + timedelta(minutes=int(i)), int(a), int(b)) for i, (a, b) in enumerate(rng.integers(-spread, spread, (n, 2)))]


@pytest.mark.parametrize(("horizon", "options"), [(None, {"lanes": 3, "coarse": 2}), (3_600_000, {"by": ["c0"]})])
def test_streamed_labels_equal_all_pairs(spark, tmp_path, horizon, options):
    rows = events(240, 1)
    rows += [(1000, rows[-1][1], None, 3), (1001, rows[-1][1], 5, 5), (1001, rows[-1][1], 5, 5), (1002, rows[-1][1], rows[-1][2], rows[-1][3])]
    lots = [rows[:100], rows[100:101], [], rows[101:]]
    links, _ = run(spark, str(tmp_path), lots, 50, horizon, **options)
    points = spark.createDataFrame(rows, SCHEMA)
    assert {r["event_id"]: r["comp"] for r in st.labels(points, links).collect()} == plain(rows, 50, horizon)


def test_a_restarted_run_emits_nothing_twice(spark, tmp_path):
    lots = [events(60, 2), []]
    links, _ = run(spark, str(tmp_path), lots[:1], 200)
    before = sorted(map(tuple, links.collect()))
    links, _ = run(spark, str(tmp_path), lots[1:], 200)
    assert before and sorted(map(tuple, links.collect())) == before


def test_timers_drop_what_is_past(spark, tmp_path):
    near = [(i, START + timedelta(hours=i), 5, 5) for i in range(200)]
    _, progress = run(spark, str(tmp_path / "timed"), [near[:100], near[100:190], near[190:]], 4, 7_200_000, coarse=2)
    held = [o for p in progress for o in p["stateOperators"]]
    assert sum(o["numRowsRemoved"] for o in held) > 0 and held[-1]["numRowsTotal"] <= 4  # of more than 40 cells
    links, _ = run(spark, str(tmp_path / "one"), [near], 4, 7_200_000)
    both = spark.read.schema(st.LINKS).parquet(str(tmp_path / "timed" / "links"))
    points = spark.createDataFrame(near, SCHEMA)
    for x in (links, both):
        assert st.labels(points, x).where("comp <> 0").count() == 0


def test_equal_vectors_are_held_once(spark, tmp_path):
    rows = [(i, START, 7, 7) for i in range(20_000)]
    links, progress = run(spark, str(tmp_path), [rows[:10_000], rows[10_000:]], 9)
    assert links.count() < 3 * len(rows)  # a forest for each cell and batch, no pairs
    assert st.labels(spark.createDataFrame(rows, SCHEMA), links).where(F.col("comp") != 0).count() == 0


def test_parts_are_joined(spark, tmp_path, monkeypatch):
    linker = st.Linker(["c0"], 4, None, None)

    class State(list):
        put = lambda self, rows: self.__setitem__(slice(None), rows)
        appendValue = list.append

    linker.stored = State()
    for k in range(2 * st.PARTS):
        held = [np.frombuffer(p[0], np.int64).reshape(-1, 3) for p in linker.stored]
        linker._store(np.array([[k, 0, 10 * k]]), np.concatenate(held) if held else np.zeros((0, 3), np.int64), len(held))
    assert len(linker.stored) <= st.PARTS + 1
    assert sorted(np.concatenate([np.frombuffer(p[0], np.int64).reshape(-1, 3) for p in linker.stored])[:, 0]) == list(range(2 * st.PARTS))
