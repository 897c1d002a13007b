"""CSV and the private binary tables: fixed-width rows after a fixed header, read in row ranges by a Python data source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from epsforest.functions.points import columns_of
from epsforest.operators.extract import with_assignment
from epsforest.operators.scan import Scan
from epsforest.operators.select import Selection
from epsforest.runtime import cut

#: Fixed values of the file formats.
KINDS = {"selected": "dclust input file v1.0", "unassigned": "dclust unassigned file v1.0", "assigned": "dclust assigned file v1.0"}
MAGIC, HEADER, ROWS_A_PARTITION = 32, 2048, 1_000_000
#: Bytes of rows that a reader gives at a time.
BATCH = 1 << 23


def read_csv(spark: SparkSession, path: str, flagged: bool = False, ordered: bool = False) -> DataFrame:
    """A headed CSV of (flag,) id and integer features, as (flag,) event_id, c0 ..; what is no integer is null.

    ``ordered`` adds ``position``, the row's place in the input (files by name), for sampling and sorting in input order. Rows are
    not moved for it: a first pass counts the lines of each byte range that Spark reads, a second one adds where its range begins.
    """
    raw = spark.read.csv(path, header=True)
    names = [*(["flag"] if flagged else []), "event_id"]
    columns = [F.col(f"`{c}`").try_cast("long").alias(names[k]) for k, c in enumerate(raw.columns[: len(names)])]
    columns += [F.col(f"`{c}`").try_cast("int").alias(f"c{k}") for k, c in enumerate(raw.columns[len(names) :])]
    if not ordered:
        return raw.select(*columns)
    # a task reads its ranges one after the other, so a row's number in its task, less that of its range's first row, is its place there
    where = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_row")]
    rows = raw.select(*columns, *where)
    ranges = raw.select(F.col("_metadata.file_path").alias("_path"), *where).groupBy("_path", "_file", "_range").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_path", "_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of a file
    starts = cut(ranges.select("_file", "_range", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")), "ranges")
    return rows.join(starts, ["_file", "_range"]).withColumn("position", F.col("_start") + F.col("_row") - F.col("_first")).drop("_file", "_range", "_row", "_first", "_start")


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, header=header)


def _row_type(kind: str, columns: int) -> np.dtype:
    value = "<u2" if kind == "selected" else "<f4"
    return np.dtype([("event_id", "<u4"), *((f"c{k}", value) for k in range(columns)), *([("cluster", "<u4")] if kind == "assigned" else [])])


def _body(kind: str) -> int:
    """Where rows begin: magic, four integers, header text; selected tables add a key, a count and a name."""
    return MAGIC + 16 + HEADER + (2 + 2 + 32 if kind == "selected" else 0)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _open(path: str):
    where, name = _filesystem(path)
    return where.open_input_file(name)


def _tables(path: str) -> list[str]:
    """The file itself, or the tables of a folder."""
    from pyarrow import fs

    where, name = _filesystem(path)
    if where.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.base_name for f in where.get_file_info(fs.FileSelector(name)) if f.is_file and f.base_name[:1] not in "._")
    if not found:
        raise ValueError(f"no table in {path}")
    return [f"{path.rstrip('/')}/{n}" for n in found]


def _facts(path: str) -> tuple[str, int, int]:
    with _open(path) as f:
        head = f.read(MAGIC + 16)
    text = head[:MAGIC].decode("ascii", "replace").rstrip("\0\n ")
    kind = next((k for k, v in KINDS.items() if v == text), None)
    if kind is None:
        raise ValueError(f"no such table: {text!r}")
    one, rows, columns, _ = np.frombuffer(head[MAGIC:], "<u4")
    if one != 1:
        raise ValueError("the file has another byte order")
    return kind, int(rows), int(columns)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, end: int) -> None:
        self.path, self.first, self.end = path, first, end


def _sort_key(path: str) -> int:
    """The column that a selected table is sorted by."""
    with _open(path) as f:
        f.seek(MAGIC + 16 + HEADER)
        return int(np.frombuffer(f.read(2), "<u2")[0])


class _Reader(DataSourceReader):
    """Row ranges of the files."""

    def __init__(self, path: str) -> None:
        self.facts = {p: _facts(p) for p in _tables(path)}
        if len({(kind, columns) for kind, _, columns in self.facts.values()}) > 1:
            raise ValueError("the folder holds tables of several kinds")
        self.kind, _, self.columns = next(iter(self.facts.values()))
        #: The least and largest value that conditions leave of a column.
        self.limits: dict[int, tuple[int, int]] = {}

    def _narrowed(self, path: str, rows: int) -> tuple[int, int]:
        key = _sort_key(path) if self.kind == "selected" else -1
        if key not in self.limits:
            return 0, rows
        row, (lo, hi) = _row_type(self.kind, self.columns), self.limits[key]
        with _open(path) as f:

            def first(least: int) -> int:
                a, b = 0, rows
                while a < b:
                    middle = (a + b) // 2
                    f.seek(_body(self.kind) + middle * row.itemsize)
                    if int(np.frombuffer(f.read(row.itemsize), row)[f"c{key}"][0]) < least:
                        a = middle + 1
                    else:
                        b = middle
                return a

            return first(lo), first(hi + 1)

    def partitions(self) -> list[_Range]:
        ends = {p: self._narrowed(p, rows) for p, (_, rows, _) in self.facts.items()}
        ranges = [_Range(p, k, min(k + ROWS_A_PARTITION, end)) for p, (first, end) in ends.items() for k in range(first, end, ROWS_A_PARTITION)]
        return ranges or [_Range(next(iter(self.facts)), 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        row = _row_type(self.kind, self.columns)
        names = ["event_id", *(f"c{k}" for k in range(self.columns)), *(["cluster"] if self.kind == "assigned" else [])]
        with _open(part.path) as f:
            f.seek(_body(self.kind) + part.first * row.itemsize)
            step = max(1, BATCH // row.itemsize)
            for first in range(part.first, max(part.end, part.first + 1), step):
                data = np.frombuffer(f.read(max(0, min(step, part.end - first)) * row.itemsize), row)
                yield pa.RecordBatch.from_arrays([pa.array(data[n].astype(np.int64 if n == "event_id" else np.int32)) for n in names], names)


class _FilteredReader(_Reader):
    """Selected tables are sorted by a column: conditions on it narrow the range of each file by binary search, reading single rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else ""
            values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None] if name[:1] == "c" and name[1:].isdigit() else []
            if values and all(isinstance(v, int) for v in values):
                lo, hi = self.limits.get(int(name[1:]), (-(2**31), 2**31))
                lo = max(lo, min(values) + isinstance(f, GreaterThan)) if not isinstance(f, (LessThan, LessThanOrEqual)) else lo
                hi = min(hi, max(values) - isinstance(f, LessThan)) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else hi
                self.limits[int(name[1:])] = lo, hi
            yield f  # ranges may hold other rows too: Spark checks all conditions again


class BinaryTable(DataSource):
    """``spark.dataSource.register(BinaryTable)``, then ``spark.read.format("density_table").load(path)``, of a file or a folder of tables.

    ``df.write.format("density_table").mode("append").option("kind", "assigned").save(folder)`` writes a folder; other
    options are ``header``, ``key`` and ``sample``. Each selected table is sorted by its key column and the one beside it; with the
    option ``push`` (and ``spark.sql.python.filterPushdown.enabled``), conditions on the key column read only the rows between their bounds.
    """

    @classmethod
    def name(cls) -> str:
        return "density_table"

    def schema(self) -> str:
        kind, _, columns = _facts(_tables(self.options["path"])[0])
        return ", ".join(["event_id long", *(f"c{k} int" for k in range(columns)), *(["cluster int"] if kind == "assigned" else [])])

    def reader(self, schema: StructType) -> DataSourceReader:
        # Spark refuses readers that take conditions while its setting for that is off
        return (_FilteredReader if self.options.get("push") == "true" else _Reader)(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("tables are only appended; give an empty folder")
        return _Writer(dict(self.options), schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A binary table or a folder of them, with conditions on the sort key pushed to the files."""
    spark.dataSource.register(BinaryTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(BinaryTable.name()).option("push", "true").load(path)


@dataclass
class _Parts(WriterCommitMessage):
    """The files that a task has written under names that no reader takes."""

    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Each task writes tables of its own, of at most ROWS_A_PARTITION rows; the commit gives them the names that readers take."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.kind, self.header = options["path"].rstrip("/"), options.get("kind", "selected"), options.get("header", "")
        self.key, self.sample = int(options.get("key", 0)), int(options.get("sample", 1))
        self.columns = len([f for f in schema.names if f[:1] == "c" and f[1:].isdigit()])
        self.row = _row_type(self.kind, self.columns)
        missing = set(self.row.names) - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def _table(self, batches: list[pa.RecordBatch]) -> str:
        where, folder = _filesystem(self.path)
        data = np.zeros(sum(b.num_rows for b in batches), self.row)
        for name in self.row.names:
            values = pa.chunked_array([b.column(b.schema.get_field_index(name)) for b in batches])
            if values.null_count:
                raise ValueError(f"{name} has missing values")
            data[name] = values.to_numpy()
        if self.kind == "selected" and len(data):  # readers rely on it
            second = 1 if self.key == 0 else self.key - 1
            by = [data[f"c{k}"] for k in (second, self.key) if k < self.columns]
            data = data[np.lexsort(by)]
        extra = self.sample if self.kind == "selected" else int(data["cluster"].max(initial=0)) if self.kind == "assigned" else 0
        name = f"_{uuid.uuid4().hex}"
        where.create_dir(folder, recursive=True)
        with where.open_output_stream(f"{folder}/{name}") as f:
            f.write(_head(self.kind, len(data), self.columns, extra, self.header, self.key))
            f.write(data.tobytes())
        return name

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        names, held, size = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_A_PARTITION):
                part = batch.slice(lo, ROWS_A_PARTITION)
                if size + part.num_rows > ROWS_A_PARTITION:
                    names.append(self._table(held))
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            names.append(self._table(held))
        return _Parts(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, folder = _filesystem(self.path)
        for k, name in enumerate(n for m in messages if m for n in m.names):
            where.move(f"{folder}/{name}", f"{folder}/part-{k:06d}{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, folder = _filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            where.delete_file(f"{folder}/{name}")


def _head(kind: str, rows: int, columns: int, extra: int, header: str, key: int) -> bytes:
    head = (KINDS[kind].ljust(MAGIC - 2) + "\n\0").encode() + np.array([1, rows, columns, extra], "<u4").tobytes()
    head += header.encode()[: HEADER - 1].ljust(HEADER, b"\0")
    return head + (np.array([key, 1], "<u2").tobytes() + b"!NO_CATEGORIES!".ljust(32, b"\0") if kind == "selected" else b"")


def write_selected(chosen: Selection, path: str, header: str = "", sample: int = 1, order: str = "event_id") -> None:
    """``path.selected``: the retained rows, sorted by key, second key and input order over all tables of the folder; ``path.leftover``: the others."""
    chosen.points.sparkSession.dataSource.register(BinaryTable)
    cols, key = columns_of(chosen.points), chosen.key
    second = 1 if key == 0 else key - 1
    by = [cols[key], *([cols[second]] if second < len(cols) else []), order]
    options = {"header": header, "key": key, "sample": sample}
    rows = chosen.points.repartitionByRange(*by).sortWithinPartitions(*by)
    rows.select("event_id", *cols).write.format("density_table").mode("append").options(kind="selected", **options).save(f"{path}.selected")
    if chosen.leftover is not None:
        chosen.leftover.select("event_id", *cols).write.format("density_table").mode("append").options(kind="unassigned", header=header).save(f"{path}.leftover")


def write_leftover(labels: DataFrame, path: str) -> None:
    """The held-out events' clusters as text without a header: event_id,cluster."""
    labels.select("event_id", "cluster").write.csv(path, header=False)


def write_split(points: DataFrame, labels: DataFrame, path: str) -> None:
    """Assigned and unassigned events as Parquet in one pass: ``path/assigned=true`` and ``path/assigned=false``."""
    with_assignment(points, labels).write.partitionBy("assigned").parquet(path)


def write_passes(found: Scan, path: str) -> None:
    """The labels of every pass as Parquet, a folder each: ``path/pass=0`` and so on, each found anew from the forest."""
    for p in found.schedule.passes:
        found.vectors.select("event_id", "weight").join(found.vector_labels_at(p.index), "event_id").select("event_id", "comp", "weight").write.parquet(f"{path.rstrip('/')}/pass={p.index}")


def write_binary(df: DataFrame, path: str, kind: str, header: str = "", key: int = 0, sample: int = 1) -> int:
    """Exports a table as one local file, streaming it partition by partition through the driver; returns the rows written.

    For programs that want a single file; ``df.write.format("density_table")`` writes a folder of tables on the executors.
    """
    columns = len(columns_of(df))
    row = _row_type(kind, columns)
    rows = df.count()
    extra = sample if kind == "selected" else int((df.agg(F.max("cluster")).first()[0] or 0) if kind == "assigned" else 0)
    with open(path, "wb") as f:
        f.write(_head(kind, rows, columns, extra, header, key))
        for batch in df.select(*row.names).toLocalIterator(prefetchPartitions=True):
            f.write(np.array(tuple(batch), row).tobytes())
    return rows
