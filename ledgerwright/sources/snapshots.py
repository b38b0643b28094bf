"""Tables whose versions are published whole.

A table is a folder of immutable files and a list of manifests:

    files/load=<run>/<partition>=<value>/part-*.parquet
    manifests/00000012.json

Every write goes to a folder of its own run. The manifest of a version names, for each
partition value, the folders that make it up, and a version exists once its manifest has
been renamed into place - the last step of a write. Readers see the version before or the
one after, whatever happens in between; a driver that dies leaves files that no manifest
names. Two writers that start from the same version cannot both publish the next one: the
rename fails for the second, which then sees `Conflict`.

A manifest holds folders, not rows: its size is the number of partition values and loads.
Earlier versions can be read until `expire` removes them with the files only they use.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOAD = "load"
_NULL = "__HIVE_DEFAULT_PARTITION__"
# Stands for the partition value in tables without any.
_WHOLE = ""


class Conflict(Exception):
    """Another writer has published the version that this one was about to."""


@dataclass(frozen=True)
class Manifest:
    """What one version consists of: partition value (as text) to folders below the table."""

    version: int
    parts: Mapping[str, list[str]]
    schema: dict
    partition: str | None
    written_at: float
    # Rows and metrics of what the version has written itself.
    written: dict
    # Whatever a writer keeps with the version; not interpreted here.
    notes: dict = field(default_factory=dict)

    def values(self) -> list[int]:
        """The partition values that are whole numbers, ascending."""
        return sorted(int(v) for v in self.parts if v not in (_NULL, _WHOLE))

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)


class SnapshotTable:
    """A table at `path`, which is shared by all executors."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._paths.Path(f"{self.path}/{name}" if name else self.path)

    # --- versions -----------------------------------------------------------------

    def versions(self) -> list[int]:
        """The published versions, ascending."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A version's manifest, by default the newest; None when nothing was published."""
        known = self.versions()
        if version is None:
            if not known:
                return None
            version = known[-1]
        elif version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        stream = self._fs.open(self._at(f"manifests/{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _publish(self, manifest: Manifest) -> None:
        """Rename the manifest into place, which fails if the version is there already."""
        made = self._at(f"manifests/.{manifest.version:08d}-{uuid.uuid4().hex}")
        place = self._at(f"manifests/{manifest.version:08d}.json")
        self._fs.mkdirs(self._at("manifests"))
        stream = self._fs.create(made)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        context = self._paths.FileContext.getFileContext(made.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._paths.Options.Rename, 0)
        try:
            context.rename(made, place, options)
        except Py4JJavaError as error:
            self._fs.delete(made, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {manifest.version} of {self.path} exists") from error
            raise

    # --- writing ------------------------------------------------------------------

    def _stored(
        self, df: DataFrame, partition: str | None, metrics: Mapping[str, Column]
    ) -> tuple[dict[str, list[str]], dict]:
        """Write rows to a new folder; partition value to the folder that holds it, and
        the metrics of the rows as they passed by."""
        load = f"files/{_LOAD}={uuid.uuid4().hex}"
        watched = Observation()
        # Taken where the files are written: a task counts once, however often it is tried.
        rows = df.hint("rebalance", *([partition] if partition else [])).observe(
            watched, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]
        )
        writer = rows.write.option("compression", "snappy")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.path}/{load}")
        seen = {k: v if isinstance(v, (int, float, type(None))) else str(v) for k, v in watched.get.items()}
        if not partition:
            return {_WHOLE: [load]}, seen
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(load)) if s.isDirectory()]
        parts = {n.partition("=")[2]: [f"{load}/{n}"] for n in names if n.startswith(f"{partition}=")}
        return parts, seen

    def write(
        self,
        df: DataFrame,
        partition: str | None,
        replaces: Callable[[str], bool] | None = None,
        appends: bool = False,
        notes: dict | None = None,
        base: Manifest | None = None,
        metrics: Mapping[str, Column] | None = None,
    ) -> Manifest:
        """Publish a version with the rows of `df`, in folders by `partition` if it has any.

        By default the new rows are the whole table. With `replaces`, partition values for
        which it holds go and all others stay; with `appends`, everything stays. `base` is
        the manifest that `df` was made from (by default the newest): if another version
        has been published since, nothing changes and `Conflict` is raised. `metrics` are
        aggregates of the rows written, taken while they are written; the manifest has
        them beside the number of rows.
        """
        before = base or self.manifest()
        kept: dict[str, list[str]] = {}
        if before is not None and (appends or replaces is not None):
            kept = {
                v: list(p) for v, p in before.parts.items() if appends or not replaces(v)
            }
        parts, seen = self._stored(df, partition, metrics or {})
        for value, folders in parts.items():
            kept[value] = kept.get(value, []) + folders
        made = Manifest(
            version=1 if before is None else before.version + 1,
            parts=kept,
            schema=json.loads(df.schema.json()),
            partition=partition,
            written_at=time.time(),
            written=seen,
            notes=notes if notes is not None else (before.notes if before else {}),
        )
        self._publish(made)
        return made

    def compact(self, most: int = 8) -> Manifest | None:
        """Rewrite partition values that more than `most` loads make up, as one load."""
        before = self.manifest()
        scattered = set() if before is None else {v for v, p in before.parts.items() if len(p) > most}
        if not scattered:
            return before
        rows = self._read(before, {v: p for v, p in before.parts.items() if v in scattered})
        return self.write(rows, before.partition, scattered.__contains__, base=before)

    def expire(self, keep: int = 2) -> list[str]:
        """Remove all but the last `keep` versions, and loads that none of those uses;
        the removed folders. Not while a write is under way."""
        known = self.versions()
        kept = {v: self.manifest(v) for v in known[-keep:]}
        for version in known[: -keep or None] if keep else known:
            self._fs.delete(self._at(f"manifests/{version:08d}.json"), False)
        used = {f for m in kept.values() for folders in m.parts.values() for f in folders}
        removed = []
        if self._fs.exists(self._at("files")):
            for load in self._fs.listStatus(self._at("files")):
                whole = f"files/{load.getPath().getName()}"
                if whole in used:
                    continue
                for folder in self._fs.listStatus(load.getPath()):
                    name = f"{whole}/{folder.getPath().getName()}"
                    if folder.isDirectory() and name not in used:
                        self._fs.delete(folder.getPath(), True)
                        removed.append(name)
                if not any(s.isDirectory() for s in self._fs.listStatus(load.getPath())):
                    self._fs.delete(load.getPath(), True)
        return sorted(removed)

    # --- reading ------------------------------------------------------------------

    def _read(
        self, manifest: Manifest, parts: Mapping[str, Iterable[str]], schema: T.StructType | None = None
    ) -> DataFrame:
        schema = schema or manifest.struct()
        folders = [f"{self.path}/{f}" for folders in parts.values() for f in folders]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/files").parquet(*folders)
        return rows.select(*schema.names)

    def read(
        self, version: int | None = None, schema: T.StructType | None = None,
        where: Callable[[str], bool] | None = None,
    ) -> DataFrame:
        """The rows of a version, by default the newest, as `schema`, by default its own.

        `where` picks partition values; folders of others are not even listed.
        """
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"nothing was published at {self.path}")
        parts = {v: p for v, p in manifest.parts.items() if where is None or where(v)}
        return self._read(manifest, parts, schema)

    def files(self, version: int | None = None) -> DataFrame:
        """`value, folder` of a version."""
        manifest = self.manifest(version)
        rows = [(v, f) for v, folders in (manifest.parts if manifest else {}).items() for f in folders]
        return self.spark.createDataFrame(rows, "value string, folder string")


def from_value(least: int) -> Callable[[str], bool]:
    """Holds for partition values that are whole numbers of `least` and more."""
    return lambda value: value not in (_NULL, _WHOLE) and int(value) >= least

