"""The registered queries of the density scan and their DuckDB SQL: one for each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsforest.functions import points as pt
from epsforest.functions.schedule import grid, threshold
from epsforest.operators import extract as ex
from epsforest.operators import forest as fo
from epsforest.operators import neighbors as nb
from epsforest.operators import select as sel
from epsforest.operators.assign import assign_unassigned
from epsforest.operators.scan import Scan, resume, scan
from epsforest.plans.pipeline import pipeline
from epsforest.runtime import cut, shared_dir
from epsforest.sources import formats
from epsforest.sources.store import Store
from epsforest.streaming import components as stream
from epsforest.streaming.score import score_stream, write_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- point sets -------------------------------------------------------------------------------------------------------
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cust2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.points(_table(spark, sf_dir, "customer"), "c_custkey", [F.col("c_nationkey") * 40, (F.col("c_acctbal") + 1000) / 10])


def part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.points(_table(spark, sf_dir, "part"), "p_partkey", ["p_size", F.floor(F.col("p_retailprice") + 0.5) - 900])


def emb(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    vector = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 1000 + 0.5).cast("int"))
    return pt.vector_points(_table(spark, sf_dir, "embeddings"), "vec_id", vector, size)


def line3(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("l_quantity").cast("int"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int"), F.floor(F.col("l_tax") * 100 + 0.5).cast("int")
    return pt.points(_table(spark, sf_dir, "lineitem"), q * 10000 + d * 100 + t, [q, d, t])


CUST2 = "SELECT c_custkey AS event_id, c_nationkey * 40 AS c0, CAST(floor((c_acctbal + 1000) / 10) AS INT) AS c1 FROM customer"
PART2 = "SELECT p_partkey AS event_id, p_size AS c0, CAST(floor(p_retailprice + 0.5) AS INT) - 900 AS c1 FROM part"
_emb = lambda n: "SELECT vec_id AS event_id, " + ", ".join(f"CAST(floor((CAST(embedding[{k + 1}] AS DOUBLE) + 1) * 1000 + 0.5) AS INT) AS c{k}" for k in range(n)) + " FROM embeddings"
LINE3 = """SELECT q * 10000 + d * 100 + t AS event_id, q AS c0, d AS c1, t AS c2 FROM (SELECT CAST(floor(l_quantity) AS INT) AS q,
  CAST(floor(l_discount * 100 + 0.5) AS INT) AS d, CAST(floor(l_tax * 100 + 0.5) AS INT) AS t FROM lineitem)"""


def _d2(n: int, a: str = "a", b: str = "b") -> str:
    return " + ".join(f"(CAST({a}.c{k} AS BIGINT) - {b}.c{k}) * (CAST({a}.c{k} AS BIGINT) - {b}.c{k})" for k in range(n))


# --- select -----------------------------------------------------------------------------------------------------------
_query("sel_points_cust2", CUST2)(cust2)
_query("sel_points_part2", PART2)(part2)
_query("sel_points_emb3", _emb(3))(lambda s, d: emb(s, d, 3))


@_query("sel_range_reject", f"SELECT event_id, c0, c1 * 20 - 500 AS c1 FROM ({CUST2}) WHERE c1 * 20 - 500 NOT BETWEEN 0 AND 16383")
def sel_range_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.out_of_range(cust2(spark, sf_dir).withColumn("c1", F.col("c1") * 20 - 500))


@_query("sel_rescale", f"SELECT event_id, CAST(floor(((c0 - lo0) * 16383) / (hi0 - lo0)) AS INT) AS c0, CAST(floor(((c1 - lo1) * 16383) / (hi1 - lo1)) AS INT) AS c1 FROM ({CUST2}), (SELECT min(c0) AS lo0, max(c0) AS hi0, min(c1) AS lo1, max(c1) AS hi1 FROM ({CUST2}))")
def sel_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.rescale(cust2(spark, sf_dir), ["c0", "c1"])


_SAMPLE = f"SELECT *, (row_number() OVER (ORDER BY event_id) - 1) % 3 <> 0 AS is_leftover FROM ({CUST2})"


@_query("sel_sample_every3", f"SELECT event_id, c0, c1 FROM ({_SAMPLE}) WHERE NOT is_leftover")
def sel_sample_every3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select(cust2(spark, sf_dir), 3).points


@_query("sel_leftover_every3", f"SELECT event_id, c0, c1 FROM ({_SAMPLE}) WHERE is_leftover")
def sel_leftover_every3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select(cust2(spark, sf_dir), 3).leftover


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/epsforest-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@_query("sel_sample_input_order", f"SELECT event_id, c0, c1 FROM (SELECT *, row_number() OVER (ORDER BY (event_id * 7919) % 100003, event_id) - 1 AS r FROM ({CUST2})) WHERE r % 3 = 0")
def sel_sample_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row in the order of CSV files whose ids are shuffled."""
    path = _folder(spark, "csv")
    order = [(F.col("event_id") * 7919) % 100003, "event_id"]
    formats.write_csv(cust2(spark, sf_dir).repartitionByRange(5, *order).sortWithinPartitions(*order), path)
    return sel.select(formats.read_csv(spark, path, ordered=True), 3, order="position").points.drop("position")


@_query("selected_table_filtered", f"SELECT event_id, c0, c1 FROM ({_SAMPLE}) WHERE NOT is_leftover AND c1 BETWEEN 300 AND 500")
def selected_table_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of the sort key, read back from the sorted binary tables that a selection leaves."""
    path = _folder(spark, "table")
    formats.write_selected(sel.select(cust2(spark, sf_dir), 3, key=1), path, "id,nation,balance", 3)
    return formats.read_table(spark, f"{path}.selected").where("c1 between 300 and 500")


@_query("leftover_table", f"SELECT event_id, c0, c1 FROM ({_SAMPLE}) WHERE is_leftover")
def leftover_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "table")
    formats.write_selected(sel.select(cust2(spark, sf_dir), 3, key=1), path)
    return formats.read_table(spark, f"{path}.leftover")


@_query("sel_counts", f"SELECT count(*) FILTER (NOT is_leftover) AS selected, count(*) FILTER (is_leftover) AS leftover FROM ({_SAMPLE})")
def sel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select(cust2(spark, sf_dir), 3).counts()


@_query("sel_flag_split", f"SELECT *, c0 % 160 = 0 AS is_leftover FROM ({CUST2})")
def sel_flag_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.split(cust2(spark, sf_dir).withColumn("flag", F.col("c0") % 160), flag="flag")


@_query("sel_flag_and_sample", f"SELECT event_id, c0, c1, f = 0 OR (row_number() OVER (PARTITION BY f = 0 ORDER BY event_id) - 1) % 3 <> 0 AS is_leftover FROM (SELECT *, c0 % 160 AS f FROM ({CUST2}))")
def sel_flag_and_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.split(cust2(spark, sf_dir).withColumn("flag", F.col("c0") % 160), 3, "flag")


_STATS = " UNION ALL ".join(
    f"SELECT {k} AS col, n, total, mean, CAST(q - 2 * mean * total + n * mean * mean AS BIGINT) AS score, least, most FROM (SELECT *, total // n AS mean FROM (SELECT count(*) AS n, CAST(sum(c{k}) AS BIGINT) AS total, CAST(sum(CAST(c{k} AS BIGINT) * c{k}) AS BIGINT) AS q, min(c{k}) AS least, max(c{k}) AS most FROM ({CUST2})))"
    for k in range(2)
)


@_query("sel_column_stats", f"SELECT col, n, total, mean, score, sqrt(score / n) AS stdev, least, most FROM ({_STATS})")
def sel_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.column_stats(cust2(spark, sf_dir))


@_query("sel_sort_key", f"SELECT col AS sort_key, CASE WHEN col = 0 THEN 1 ELSE col - 1 END AS second_key FROM ({_STATS}) ORDER BY score DESC, col LIMIT 1")
def sel_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.sort_key(sel.column_stats(cust2(spark, sf_dir)))


@_query("sel_sorted_rank", f"SELECT *, row_number() OVER (ORDER BY c1, c0, event_id) - 1 AS sorted_rank FROM ({CUST2})")
def sel_sorted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.sorted_points(cust2(spark, sf_dir), 1)


@_query("sel_key_histogram", f"SELECT c1 AS value, count(*) AS n FROM ({CUST2}) GROUP BY 1")
def sel_key_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.key_histogram(cust2(spark, sf_dir), 1)


# --- joins ------------------------------------------------------------------------------------------------------------
def _edges_sql(points: str, n: int, t: int) -> str:
    return f"SELECT a.event_id AS a, b.event_id AS b, {_d2(n)} AS d2 FROM ({points}) a JOIN ({points}) b ON a.event_id < b.event_id WHERE {_d2(n)} <= {t}"


_query("eps_edges_cust2", _edges_sql(CUST2, 2, 200))(lambda s, d: nb.edges(cust2(s, d), threshold(10, 2)))
_query("eps_edges_part2", _edges_sql(PART2, 2, 2))(lambda s, d: nb.edges(part2(s, d), threshold(1, 2)))
_query("eps_edges_emb64", _edges_sql(_emb(64), 64, 1254400))(lambda s, d: nb.edges(emb(s, d, 64), threshold(140, 64), strategy="blocks"))


_query("eps_edges_emb64_pivots", _edges_sql(_emb(64), 64, 1254400))(lambda s, d: nb.block_pairs(emb(s, d, 64), threshold(140, 64), block_rows=64))


_query("eps_edges_cust2_dealt", _edges_sql(CUST2, 2, 200))(lambda s, d: nb.block_pairs(cust2(s, d), threshold(10, 2), block_rows=256, tasks=6))


@_query("eps_degree", f"WITH e AS ({_edges_sql(CUST2, 2, 200)}) SELECT event_id, count(*) AS degree FROM (SELECT a AS event_id FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def eps_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.degrees(nb.edges(cust2(spark, sf_dir), threshold(10, 2)))


@_query("dedup_points_line3", f"SELECT event_id, c0, c1, c2, count(*) AS weight FROM ({LINE3}) GROUP BY ALL")
def dedup_points_line3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.collapse(line3(spark, sf_dir))


# --- scans ------------------------------------------------------------------------------------------------------------
FIRST, LAST, STEP, LEAST = 4.0, 30.0, 2.0, 12


def _labels_sql(points: str, n: int, distances: list[float], least: int, also: str = "") -> str:
    """Common tables p, t, labels, sizes, kept for scans that visit every distance of their grid."""
    ts = ", ".join(f"({k}, {d!r}, {threshold(d, n)})" for k, d in enumerate(distances))
    top = max(threshold(d, n) for d in distances)
    return f"""
WITH RECURSIVE p AS ({points}), t(pass, dist, thr) AS (VALUES {ts}),
d AS MATERIALIZED (SELECT a.event_id AS a, b.event_id AS b, {_d2(n)} AS d2 FROM p a JOIN p b ON a.event_id < b.event_id {also} WHERE {_d2(n)} <= {top}),
e AS MATERIALIZED (SELECT pass, a, b FROM d JOIN t ON d2 <= thr UNION ALL SELECT pass, b, a FROM d JOIN t ON d2 <= thr),
cc(pass, id, c) USING KEY (pass, id) AS (
  SELECT pass, event_id, event_id FROM p, t
  UNION SELECT e.pass, e.b, min(cc.c) FROM cc JOIN e ON e.pass = cc.pass AND e.a = cc.id JOIN recurring.cc r ON r.pass = e.pass AND r.id = e.b WHERE cc.c < r.c GROUP BY e.pass, e.b
),
labels AS MATERIALIZED (SELECT pass, id AS event_id, c AS comp FROM cc),
sizes AS (SELECT pass, comp, count(*) AS size FROM labels GROUP BY ALL),
kept AS (SELECT * FROM sizes WHERE size >= {least})"""


_LINEAGE = """,
member AS (SELECT l.pass, l.event_id, l.comp FROM labels l JOIN kept USING (pass, comp)),
born AS (SELECT m.pass, m.comp FROM member m LEFT JOIN member b ON b.pass = m.pass - 1 AND b.event_id = m.event_id GROUP BY m.pass, m.comp HAVING count(b.comp) = 0),
held AS (SELECT l.pass, l.comp, count(*) AS births FROM labels l JOIN born b ON b.comp = l.event_id AND l.pass >= b.pass GROUP BY ALL),
base AS (SELECT k.pass, k.comp, k.size, b.comp IS NOT NULL AS birth, h.births, u.comp AS parent FROM kept k LEFT JOIN born b USING (pass, comp) JOIN held h USING (pass, comp) LEFT JOIN labels u ON u.pass = k.pass + 1 AND u.event_id = k.comp),
fam AS (SELECT pass, parent, count(*) AS siblings, min(comp) AS first FROM base WHERE parent IS NOT NULL GROUP BY ALL),
lineage AS (
  SELECT b.pass, b.comp, b.size, b.birth, b.births, b.parent, coalesce(f.siblings, 0) AS siblings, CASE WHEN f.siblings > 1 AND b.comp <> f.first THEN f.first END AS merged_to,
    g.first AS descends_from, coalesce(b.births = 1 AND (b.pass = (SELECT max(pass) FROM t) OR h.births >= 2), false) AS leaf, b.pass = (SELECT max(pass) FROM t) AND b.birth AS late
  FROM base b LEFT JOIN fam f USING (pass, parent) LEFT JOIN fam g ON g.pass = b.pass - 1 AND g.parent = b.comp LEFT JOIN held h ON h.pass = b.pass + 1 AND h.comp = b.parent
),
chosen AS (SELECT CAST(row_number() OVER (ORDER BY pass, comp) AS INT) AS cluster, pass, comp, size FROM lineage WHERE leaf AND NOT late),
final AS (SELECT p.event_id, coalesce(max(c.cluster), 0) AS cluster FROM p LEFT JOIN labels l USING (event_id) LEFT JOIN chosen c ON c.pass = l.pass AND c.comp = l.comp GROUP BY p.event_id)"""

_GRID = grid(FIRST, LAST, STEP)
_CUST = _labels_sql(CUST2, 2, _GRID, LEAST)


def _scan(spark: SparkSession, sf_dir: str, **options) -> Scan:
    return scan(cust2(spark, sf_dir), FIRST, LAST, STEP, **({"min_events": LEAST, "go_on_decrease": True} | options))


def _at(points: DataFrame, dist: float, least: int = 2) -> Scan:
    return scan(points, dist, min_events=least)


@_query("components_cust2", _labels_sql(CUST2, 2, [10.0], 2) + " SELECT event_id, comp FROM labels")
def components_cust2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(cust2(spark, sf_dir), 10).labels_at(0)


@_query("components_part2", _labels_sql(PART2, 2, [1.0], 2) + " SELECT event_id, comp FROM labels")
def components_part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(part2(spark, sf_dir), 1).labels_at(0)


@_query("components_line3", _labels_sql(f"SELECT DISTINCT * FROM ({LINE3})", 3, [0.6], 2) + " SELECT event_id, comp FROM labels")
def components_line3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(nb.collapse(line3(spark, sf_dir)).drop("weight"), 0.6).labels_at(0)


@_query("component_sizes", _labels_sql(CUST2, 2, [10.0], 2) + " SELECT comp, size FROM kept")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(cust2(spark, sf_dir), 10).retained().select("comp", "size")


@_query("retained_sizes", _CUST + " SELECT CAST(pass AS INT) AS pass, comp, size FROM kept")
def retained_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).retained()


_STATS_SQL = f""" SELECT CAST(t.pass AS INT) AS pass, CAST(dist AS DOUBLE) AS dist, CAST(thr AS BIGINT) AS threshold, count(*) FILTER (size >= 2) AS raw, count(*) FILTER (size >= {LEAST}) AS retained,
  CAST(coalesce(sum(size) FILTER (size >= {LEAST}), 0) AS BIGINT) AS assigned, CAST(sum(size) - coalesce(sum(size) FILTER (size >= {LEAST}), 0) AS BIGINT) AS unassigned FROM t JOIN sizes USING (pass) GROUP BY ALL"""


@_query("scan_stats_cust2", _CUST + _STATS_SQL)
def scan_stats_cust2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).stats()


@_query("scan_best_dist", f"SELECT dist, retained FROM ({_CUST + _STATS_SQL}) ORDER BY retained DESC, pass DESC LIMIT 1")
def scan_best_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _scan(spark, sf_dir).stats().agg(F.max_by("dist", F.struct("retained", "pass")).alias("dist"), F.max("retained").alias("retained"))
    return best


_REPORT = f"""SELECT pass, dist, 1 AS sample_every, CAST(assigned + unassigned AS BIGINT) AS events, assigned, unassigned,
  CAST(CAST(100.0 * assigned::DOUBLE / (assigned + unassigned) AS FLOAT) AS DOUBLE) AS percent, raw, retained FROM ({_CUST + _STATS_SQL})"""


@_query("scan_pass_report", _REPORT)
def scan_pass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).report()


def _until(least: int, first: float, last: float, step: float, percent: float, decrease: bool) -> str:
    """The passes up to the first at which a stop rule holds, of a scan that never doubles its step."""
    stats = _STATS_SQL.replace(f"size >= {LEAST}", f"size >= {least}")
    fewer = "OR retained < coalesce(max(retained) OVER (ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if decrease else ""
    return f"""SELECT pass, dist, threshold, raw, retained, assigned, unassigned FROM (
  SELECT *, coalesce(max(CAST(stop AS INT)) OVER (ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM (
    SELECT *, (raw = 1 AND retained >= 1 AND pass > 0) OR 100.0 * assigned / (assigned + unassigned) >= {percent} {fewer} AS stop
    FROM ({_labels_sql(CUST2, 2, grid(first, last, step), least) + stats}))) WHERE stopped = 0"""


@_query("scan_stops_when_assigned", _until(LEAST, FIRST, LAST, STEP, 70, False))
def scan_stops_when_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, stop_percent=70).stats()


@_query("scan_stops_on_decrease", _until(LEAST, FIRST, LAST, STEP, 95, True))
def scan_stops_on_decrease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, go_on_decrease=False).stats()


@_query("lineage_births", _CUST + _LINEAGE + " SELECT CAST(pass AS INT) AS pass, comp, size FROM lineage WHERE birth")
def lineage_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).lineage().where("birth").select("pass", "comp", "size")


@_query("lineage_children", _CUST + _LINEAGE + " SELECT CAST(pass AS INT) AS pass, comp, parent, siblings, births, descends_from FROM lineage")
def lineage_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).lineage().select("pass", "comp", "parent", "siblings", "births", "descends_from")


@_query("lineage_mergedto", _CUST + _LINEAGE + " SELECT CAST(pass AS INT) AS pass, comp, merged_to FROM lineage WHERE merged_to IS NOT NULL")
def lineage_mergedto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).lineage().where("merged_to is not null").select("pass", "comp", "merged_to")


@_query("selected_clusters", _CUST + _LINEAGE + " SELECT cluster, CAST(pass AS INT) AS pass, comp, size FROM chosen")
def selected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).clusters()


@_query("selected_compat_off", _labels_sql(CUST2, 2, grid(4, 14, 2), 5) + _LINEAGE + " SELECT CAST(pass AS INT) AS pass, comp, size FROM lineage WHERE leaf")
def selected_compat_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(cust2(spark, sf_dir), 4, 14, 2, min_events=5, go_on_decrease=True, compat=False)
    return found.clusters().select("pass", "comp", "size")


@_query("final_labels", _CUST + _LINEAGE + " SELECT event_id, cluster FROM final")
def final_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).final_labels()


_NEAREST = f""",
alive AS (SELECT l.event_id FROM labels l JOIN sizes USING (pass, comp) WHERE l.pass = (SELECT max(pass) FROM t) AND size >= 2),
near AS (
  SELECT q.event_id, f.cluster, min({_d2(2, "q", "x")}) AS d2 FROM final g JOIN alive USING (event_id) JOIN p q USING (event_id), final f JOIN p x ON x.event_id = f.event_id
  WHERE g.cluster = 0 AND f.cluster > 0 GROUP BY ALL
), best AS (SELECT event_id, min(cluster) AS cluster, count(*) AS n FROM near JOIN (SELECT event_id, min(d2) AS d2 FROM near GROUP BY 1) USING (event_id, d2) GROUP BY event_id)"""


@_query("assign_unassigned", _CUST + _LINEAGE + _NEAREST + " SELECT event_id, CASE WHEN f.cluster > 0 THEN f.cluster WHEN n = 1 THEN best.cluster ELSE 0 END AS cluster FROM final f LEFT JOIN best USING (event_id)")
def assign_unassigned_cust2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir)
    return assign_unassigned(found, cut(found.final_labels(), "final"))


@_query("assign_ambiguous", _CUST + _LINEAGE + _NEAREST + " SELECT event_id FROM best WHERE n > 1")
def assign_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir)
    labels = cut(found.final_labels(), "final")
    still = assign_unassigned(found, labels).where("cluster = 0")
    return still.join(found.last_labels(), "event_id", "left_semi").select("event_id")


_SAMPLED = _labels_sql(f"SELECT event_id, c0, c1 FROM ({_SAMPLE}) WHERE NOT is_leftover", 2, _GRID, 5) + _LINEAGE
_LEFT = f""",
o AS (SELECT event_id, c0, c1 FROM ({_SAMPLE}) WHERE is_leftover),
near AS (SELECT q.event_id, f.cluster, min({_d2(2, "q", "x")}) AS d2 FROM o q, final f JOIN p x ON x.event_id = f.event_id WHERE f.cluster > 0 GROUP BY ALL),
best AS (SELECT event_id, min(cluster) AS cluster, count(*) AS n FROM near JOIN (SELECT event_id, min(d2) AS d2 FROM near GROUP BY 1) USING (event_id, d2) WHERE d2 <= {threshold(LAST + STEP, 2)} GROUP BY event_id),
rest AS (SELECT event_id, CASE WHEN n = 1 THEN best.cluster ELSE 0 END AS cluster FROM o LEFT JOIN best USING (event_id))"""


def _sampled(spark: SparkSession, sf_dir: str):
    return pipeline(cust2(spark, sf_dir), FIRST, LAST, STEP, sample_every=3, leftover=True, min_events=5)


@_query("assign_leftover", _SAMPLED + _LEFT + " SELECT event_id, cluster FROM rest")
def assign_leftover_cust2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).leftover_labels


@_query("final_union", _SAMPLED + _LEFT + " SELECT event_id, cluster FROM final UNION ALL SELECT event_id, cluster FROM rest")
def final_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).result


@_query("extract_cluster", _CUST + _LINEAGE + " SELECT event_id, c0, c1, cluster FROM final JOIN p USING (event_id) WHERE cluster = 1")
def extract_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir)
    return ex.extract(found.points, found.final_labels(), 1)


@_query("extract_sub", _CUST + _LINEAGE + " SELECT event_id, c0, c1, 1 AS cluster FROM final JOIN p USING (event_id) WHERE cluster = 2")
def extract_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir)
    return ex.sub_extract(found.points, found.final_labels(), 2)


@_query("extract_unassigned", _CUST + _LINEAGE + " SELECT event_id, c0, c1, cluster FROM final JOIN p USING (event_id) WHERE cluster = 0")
def extract_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir)
    return ex.unassigned(found.points, found.final_labels())


@_query("summary_counts", _CUST + _LINEAGE + " SELECT cluster, count(*) AS events FROM final GROUP BY 1")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.summary(_scan(spark, sf_dir).final_labels())


_SEGMENT = " final f JOIN customer c ON c.c_custkey = f.event_id"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("segment"))
    return _scan(spark, sf_dir).final_labels().join(segments, "event_id")


@_query("summary_by_category", _CUST + _LINEAGE + f" SELECT c_mktsegment AS segment, cluster, count(*) AS events FROM {_SEGMENT} GROUP BY ALL")
def summary_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.summary(_segments(spark, sf_dir), "segment")


@_query(
    "summary_table",
    _CUST + _LINEAGE + " SELECT c_mktsegment AS segment, " + ", ".join(f"count(*) FILTER (cluster = {k}) AS cluster_{k}" for k in range(4)) + f" FROM {_SEGMENT} GROUP BY 1",
)
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.summary_table(_segments(spark, sf_dir), "segment", 3)


@_query("max_cluster_id", _CUST + _LINEAGE + " SELECT max(cluster) AS max_cluster FROM final")
def max_cluster_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.max_cluster(_scan(spark, sf_dir).final_labels())


_AGAIN = _labels_sql(f"SELECT event_id, c0, c1 FROM ({_CUST + _LINEAGE} SELECT event_id, c0, c1 FROM final JOIN p USING (event_id) WHERE cluster = 0)", 2, grid(10, 30, 5), 5) + _LINEAGE


@_query("recluster_unassigned", _AGAIN + " SELECT event_id, cluster FROM final")
def recluster_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir)
    labels = cut(found.final_labels(), "final")
    return ex.recluster(found, labels, "unassigned", first=10, last=30, step=5, min_events=5, go_on_decrease=True)[0].final_labels()


_MEMBERS = _labels_sql(f"SELECT event_id, c0, c1, g FROM ({_CUST + _LINEAGE} SELECT event_id, c0, c1, cluster AS g FROM final JOIN p USING (event_id) WHERE cluster > 0)", 2, [6.0], 3, "AND a.g = b.g")


@_query(
    "recluster_clusters",
    _MEMBERS + """, again AS (SELECT event_id, g, dense_rank() OVER (PARTITION BY g ORDER BY comp) AS cluster FROM labels JOIN kept USING (pass, comp) JOIN p USING (event_id))
  SELECT p.g AS parent, p.event_id, coalesce(again.cluster, 0) AS cluster FROM p LEFT JOIN again USING (event_id)""",
)
def recluster_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir)
    labels = cut(found.final_labels(), "final")
    return ex.recluster_together(found, labels, 6, min_events=3, compat=False)


@_query(
    "lineage_history",
    _CUST + _LINEAGE + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY comp) AS cluster FROM lineage)
  SELECT CAST(n.pass AS INT) AS pass, CAST(t.dist AS DOUBLE) AS dist, n.cluster, n.size, coalesce(b.cluster, 0) AS descendfrom, coalesce(m.cluster, 0) AS mergedto, n.leaf AND NOT n.late AS retain
  FROM numbered n JOIN t USING (pass) LEFT JOIN numbered b ON b.pass = n.pass - 1 AND b.comp = n.descends_from LEFT JOIN numbered m ON m.pass = n.pass AND m.comp = n.merged_to""",
)
def lineage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).history()


@_query("split_by_assignment", _CUST + _LINEAGE + " SELECT event_id, c0, c1, cluster, cluster > 0 AS assigned FROM final JOIN p USING (event_id)")
def split_by_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir)
    return cut(ex.with_assignment(found.points, found.final_labels()), "split", by=["assigned"])


# --- the same on bounds so small that everything is distributed -------------------------------------------------------------
@_query(
    "forest_edges_by_pass",
    _CUST + " SELECT CAST(pass AS INT) AS pass, CAST(thr AS BIGINT) AS threshold, count(*) - count(DISTINCT comp) AS edges FROM labels JOIN t USING (pass) GROUP BY ALL",
)
def forest_edges_by_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges of the minimum spanning forest each threshold has, by a tree of small blocks and Borůvka rounds."""
    thresholds = [(k, threshold(d, 2)) for k, d in enumerate(_GRID)]
    found = fo.minimum_forest(nb.collapse(cust2(spark, sf_dir)).drop("weight"), thresholds[-1][1], rows=64, few=200, fan=4, direct=4)
    copies = cust2(spark, sf_dir).groupBy("c0", "c1").agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("copies"))
    by_pass = spark.createDataFrame(thresholds, "pass int, threshold long").join(F.broadcast(copies))
    return by_pass.join(found.select("d2"), F.col("d2") <= F.col("threshold"), "left").groupBy("pass", "threshold", "copies").agg(F.count("d2").alias("n")).select("pass", "threshold", (F.col("n") + F.col("copies")).alias("edges"))


@_query("scan_distributed_lineage", _CUST + _LINEAGE + " SELECT CAST(pass AS INT) AS pass, comp, size, birth, births, parent, siblings, merged_to, descends_from, leaf AND NOT late AS selected FROM lineage")
def scan_distributed_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan in bands over many small blocks, whose first passes are distributed and whose last ones fit a task."""
    return _scan(spark, sf_dir, few=400, block_rows=64, few_blocks=0).lineage()


@_query("scan_distributed_labels", _labels_sql(CUST2, 2, grid(4, 14, 5), 5) + _LINEAGE + " SELECT event_id, cluster FROM final")
def scan_distributed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of which every pass is distributed."""
    return scan(cust2(spark, sf_dir), 4, 14, 5, min_events=5, go_on_decrease=True, few=0, block_rows=100, few_blocks=0).final_labels()


@_query("scan_resumed_lineage", _CUST + _LINEAGE + " SELECT CAST(pass AS INT) AS pass, comp, size, birth, births, parent, siblings, merged_to, descends_from, leaf AND NOT late AS selected FROM lineage")
def scan_resumed_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan to half of the distance with other rules is stored; a second one goes on from its edges."""
    path = _folder(spark, "store")
    scan(cust2(spark, sf_dir), FIRST, 14, STEP, min_events=40, block_rows=64, few_blocks=0, store=Store(spark, path))
    return resume(Store(spark, path), FIRST, LAST, STEP, min_events=LEAST, go_on_decrease=True, block_rows=64, few_blocks=0).lineage()


# --- streams ----------------------------------------------------------------------------------------------------------
EVENTS2 = "SELECT event_id, CAST(floor(value) AS INT) AS c0, CAST(user_id AS INT) AS c1, ts FROM events"
DAY = 86_400_000


def _streamed_labels(spark: SparkSession, sf_dir: str, dist: float, horizon: int | None = None, **options) -> DataFrame:
    """Components of ``events`` that arrive in three lots by time; every lot is a run of its own that goes on from the checkpoint."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", F.floor("value").cast("int").alias("c0"), F.col("user_id").cast("int").alias("c1"))
    path = _folder(spark, "stream")
    when = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    cuts = events.select(when.alias("s")).approxQuantile("s", [0.33, 0.67], 0.01)
    lots = [when.isNull(), *(when <= c for c in cuts), F.lit(True)] if cuts else [F.lit(True)]
    stream.with_rocksdb(spark)
    lot = F.coalesce(*(F.when(x, k) for k, x in enumerate(lots)))
    for k in range(len(lots)):
        events.where(lot == k).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        links = stream.link_stream(source, threshold(dist, 2), horizon, delay="1 minute", **options)
        stream.write_links(links, f"{path}/links", f"{path}/checkpoint").awaitTermination()
    return stream.labels(events, spark.read.schema(stream.LINKS).parquet(f"{path}/links"))


@_query("stream_components", _labels_sql(EVENTS2, 2, [3.0], 2) + " SELECT event_id, comp FROM labels")
def stream_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_labels(spark, sf_dir, 3, lanes=2)


@_query("stream_components_by_time", _labels_sql(EVENTS2, 2, [5.0], 2, f"AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) <= {DAY}") + " SELECT event_id, comp FROM labels")
def stream_components_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of events no more than a day apart; states of past days are dropped."""
    return _streamed_labels(spark, sf_dir, 5, DAY)


@_query(
    "stream_scores",
    _CUST + _LINEAGE + f""", q AS (SELECT event_id, c0, c1 + 3 AS c1 FROM p),
near AS (SELECT q.event_id, f.cluster, min({_d2(2, "q", "x")}) AS d2 FROM q, final f JOIN p x ON x.event_id = f.event_id WHERE f.cluster > 0 AND {_d2(2, "q", "x")} <= {threshold(10, 2)} GROUP BY ALL),
best AS (SELECT event_id, min(cluster) AS cluster, count(*) AS n FROM near JOIN (SELECT event_id, min(d2) AS d2 FROM near GROUP BY 1) USING (event_id, d2) GROUP BY event_id)
SELECT event_id, CASE WHEN n = 1 THEN cluster ELSE 0 END AS cluster FROM best""",
)
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted points stream in and get the nearest cluster in reach of a finished scan."""
    found, path = _scan(spark, sf_dir), _folder(spark, "scores")
    targets = cut(found.points.join(found.final_labels().where("cluster > 0"), "event_id"), "targets")
    cust2(spark, sf_dir).withColumn("c1", (F.col("c1") + 3).cast("int")).write.parquet(f"{path}/in")
    source = spark.readStream.schema("event_id long, c0 int, c1 int").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    write_scores(score_stream(source, targets, threshold(10, 2)), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long, cluster int").parquet(f"{path}/out/batch=*")
