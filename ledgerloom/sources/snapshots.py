"""Tables in versions that appear whole or not at all, for batches that decide on what others may change."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


class Snapshots:
    """Versions of named tables under one folder.

    A version is a manifest that lists each table's Parquet folders. It is
    written beside and renamed to its number, which fails if that number is there:
    of two writers that start from the same version one wins and the other is told.
    The rename is atomic where the file system's is (HDFS); a local one checks first
    and object stores need a committer of their own. Folders of a lost attempt are
    in no manifest and so never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _manifest(self, version: int) -> dict[str, list[str]]:
        if version == 0:
            return {}
        at = self._at(f"_versions/{version:012d}.json")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> int:
        """The newest version; 0 before the first."""
        at = self._at("_versions")
        fs = at.getFileSystem(self._conf)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest); one that is not there is empty."""
        folders = self._manifest(self.latest() if version is None else version).get(name, [])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, base: int, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame | None] | None = None) -> int:
        """Version base + 1: rows appended to tables, tables replaced (None: emptied). Conflict if it is there already."""
        manifest = self._manifest(base)
        for name, df in (replace or {}).items():
            manifest[name] = [] if df is None else [self._write(name, df)]
        for name, df in (append or {}).items():
            manifest[name] = manifest.get(name, []) + [self._write(name, df)]
        self._publish(base + 1, manifest)
        return base + 1

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def _publish(self, version: int, manifest: dict[str, list[str]]) -> None:
        beside, target = self._at(f"_versions/.{uuid.uuid4().hex}"), self._at(f"_versions/{version:012d}.json")
        fs = beside.getFileSystem(self._conf)
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        none[0] = self._fs.Options.Rename.NONE
        try:
            self._fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(beside, target, none)
        except Py4JJavaError as e:
            fs.delete(beside, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} is there already") from e
            raise

    def update(self, step: Callable[[int], dict], attempts: int = 10) -> int:
        """step(version) gives commit()'s arguments on what that version holds; after a conflict it is asked again on the new one."""
        for _ in range(attempts):
            base = self.latest()
            try:
                return self.commit(base, **step(base))
            except Conflict:
                continue
        raise Conflict(f"no version of this batch's in {attempts} attempts")
