"""A store of a scan's forest: what a later run needs to go on, to reach farther or to decide otherwise, without finding edges again.

A folder holds the points, the distinct vectors and the edges of each band of thresholds, as Parquet, and manifests. A manifest names
the tables that belong to the store and how far their edges reach; it is written aside and renamed, so it is there whole or not at all, and
the last one counts. What a run that was killed left without a manifest is not read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Manifest:
    """events, vectors: their numbers; columns: what thresholds reckon with; floor: the first threshold; reach: the last that the edges serve."""

    points: str
    vectors: str
    events: int
    distinct: int
    columns: int
    floor: int
    reach: int = -1
    bands: list[str] = field(default_factory=list)


class Store:
    """The folder ``path``, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest: Manifest | None = None
        names = self._manifests()
        if names:
            text = self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0]
            self.manifest = Manifest(**json.loads(text))

    def _manifests(self) -> list[str]:
        if not self._files.exists(self._path(self.path)):
            return []
        names = (f.getPath().getName() for f in self._files.listStatus(self._path(self.path)))
        return sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _write(self, df: DataFrame, name: str) -> str:
        name = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, manifest: Manifest) -> None:
        number = len(self._manifests())
        aside, last = self._path(f"{self.path}/_{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{number:08d}.json")
        out = self._files.create(aside)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        if not self._files.rename(aside, last):
            raise RuntimeError(f"another run has written {last}")
        self.manifest = manifest

    def begin(self, points: DataFrame, vectors: DataFrame, events: int, distinct: int, columns: int, floor: int) -> None:
        """Writes the points of a new store; a store that is there is only begun for the same scan."""
        if self.manifest:
            raise ValueError(f"{self.path} holds a scan already")
        self._commit(Manifest(self._write(points, "points"), self._write(vectors, "vectors"), events, distinct, columns, floor))

    def add(self, edges: DataFrame, reach: int) -> None:
        """Edges (a, b, d2) that, with those before, serve all thresholds up to ``reach``."""
        m = self.manifest
        self._commit(Manifest(**asdict(m) | {"reach": reach, "bands": [*m.bands, self._write(edges.select("a", "b", "d2"), "edges")]}))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def forest(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.table, self.manifest.bands))
