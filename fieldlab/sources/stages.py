"""Stages kept in the shared folder: written once, found again, removed at the end.

A stage is a folder with one subfolder per version. The version is a digest of
what the rows follow from: the stage's name, its parameters, and the versions or
files of its inputs. A version counts as whole once its manifest, one Parquet row
written after the data, is there; anything else was left by a run that died and
is written anew. A run started again with the same store therefore goes on behind
its last whole stage, and a changed parameter or input file changes the version
of the stage and of all that follow from it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

_MANIFEST = "stage string, version string, data_schema string, n_rows long, partitions array<string>, inputs array<string>"


class StageStore:
    """Named stages below ``<shared folder>/stages/<name>``.

    Used as a context manager it keeps everything if the block raises, so the next
    run can go on, and removes its own folder after a whole run unless ``keep``.
    """

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        if not name or "/" in name:
            raise ValueError("a store needs a plain folder name")
        self.spark, self.keep = spark, keep
        self.base = f"{shared_dir(spark)}/stages/{name}"
        self.written: list[str] = []
        self.reused: list[str] = []
        self._versions: dict[str, str] = {}

    def __enter__(self) -> StageStore:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None and not self.keep:
            self.close()

    # --- files -------------------------------------------------------------

    def _path(self, path: str):
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(context._jsc.hadoopConfiguration()), found

    def _exists(self, path: str) -> bool:
        system, found = self._path(path)
        return system.exists(found)

    def _remove(self, path: str) -> None:
        system, found = self._path(path)
        system.delete(found, True)

    def _folders(self, path: str) -> list[str]:
        system, found = self._path(path)
        return [s.getPath().getName() for s in system.listStatus(found) if s.isDirectory()] if system.exists(found) else []

    def _files_mark(self, path: str) -> str:
        """Names, lengths and times of the files of an input path."""
        system, found = self._path(path)
        seen = hashlib.sha256()
        walk = system.listFiles(found, True)
        entries = []
        while walk.hasNext():
            s = walk.next()
            entries.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
        for e in sorted(entries):
            seen.update(e.encode() + b"\n")
        return seen.hexdigest()

    # --- stages ------------------------------------------------------------

    def version(self, stage: str, inputs: Sequence[str] = (), params: Mapping | None = None) -> str:
        """Digest of what the stage follows from; inputs are names of earlier stages or paths of files."""
        marks = [self._versions[i] if i in self._versions else self._files_mark(i) for i in inputs]
        text = json.dumps([stage, marks, params or {}], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()[:24]

    def stage(self, name: str, build: Callable[[], DataFrame], inputs: Sequence[str] = (), params: Mapping | None = None,
              partition_by: Sequence[str] = ()) -> DataFrame:
        """The stage's table: read if this version is whole, else built, written and read.

        ``build`` is called only if there is something to write. Older versions of
        the stage go once the new one is whole.
        """
        version = self.version(name, inputs, {"by": list(partition_by), "params": params or {}})
        here = f"{self.base}/{name}/{version}"
        if self._exists(f"{here}/manifest/_SUCCESS"):
            self.reused.append(name)
        else:
            self._remove(here)
            df = build()
            self._write(df, f"{here}/data", partition_by, "overwrite")
            self._note(name, version, here, df.schema, partition_by, inputs)
            self.written.append(name)
        for other in self._folders(f"{self.base}/{name}"):
            if other != version:
                self._remove(f"{self.base}/{name}/{other}")
        self._versions[name] = version
        return self.read(name)

    def replace_partitions(self, name: str, df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
        """Overwrite only those partitions of a whole stage that ``df`` has rows for.

        ``df`` may not read the stage itself. While the write runs the stage counts
        as not whole, so a run that dies here writes it anew. The stage has a new
        version afterwards, for this store and what follows.
        """
        version = self._versions[name]
        here = f"{self.base}/{name}/{version}"
        note = self.spark.read.schema(_MANIFEST).parquet(f"{here}/manifest").first()
        schema = T.StructType.fromJson(json.loads(note.data_schema))
        self._remove(f"{here}/manifest")
        self._write(df.select(*schema.names), f"{here}/data", partition_by, "dynamic")
        version = hashlib.sha256(f"{version}:{self._files_mark(f'{here}/data')}".encode()).hexdigest()[:24]
        there = f"{self.base}/{name}/{version}"
        system, old = self._path(here)
        system.rename(old, self._path(there)[1])
        self._note(name, version, there, schema, partition_by, note.inputs)
        self._versions[name] = version
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """A whole stage of this run."""
        here = f"{self.base}/{name}/{self._versions[name]}"
        note = self.spark.read.schema(_MANIFEST).parquet(f"{here}/manifest").first()
        schema = T.StructType.fromJson(json.loads(note.data_schema))
        return self.spark.read.schema(schema).parquet(f"{here}/data").select(*schema.names)

    def manifests(self) -> DataFrame:
        """One row per whole stage of this run: version, rows, partition columns, inputs."""
        paths = [f"{self.base}/{n}/{v}/manifest" for n, v in self._versions.items()]
        empty = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(_MANIFEST).fields])
        return self.spark.read.schema(_MANIFEST).parquet(*paths) if paths else empty

    def close(self) -> None:
        """Remove everything this store holds."""
        self._remove(self.base)
        self._versions.clear()

    def _write(self, df: DataFrame, path: str, partition_by: Sequence[str], mode: str) -> None:
        if partition_by:
            # One writer per value and slice of rows; small files are merged by size.
            df = df.hint("rebalance", *partition_by)
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if mode == "dynamic" else "static")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    def _note(self, name: str, version: str, here: str, schema: T.StructType, partition_by: Sequence[str],
              inputs: Sequence[str]) -> None:
        rows = self.spark.read.schema(schema).parquet(f"{here}/data").groupBy().agg(F.count(F.lit(1)).alias("n_rows"))
        texts = F.array().cast("array<string>")
        (rows.select(F.lit(name).alias("stage"), F.lit(version).alias("version"), F.lit(schema.json()).alias("data_schema"), "n_rows",
                     (F.array(*[F.lit(p) for p in partition_by]) if partition_by else texts).alias("partitions"),
                     (F.array(*[F.lit(i) for i in inputs]) if inputs else texts).alias("inputs"))
         .coalesce(1).write.parquet(f"{here}/manifest"))
