"""A catalogue kept in versions: a change writes the buckets that it touches, and is seen whole or not at all.

Tables of files lie in buckets of the hash of their path, each bucket a folder of
Parquet; a manifest for each version names the folders of all tables.  A change
reads the buckets of its keys, writes new folders for them and then the next
manifest, which names the old folders of everything else.  A manifest appears
under its number by a rename that fails if the number is taken, so of two writers
one wins and the other starts again from the new version; a writer that dies
leaves the last version as it was.  The store must have such a rename, as HDFS and
local file systems do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenframe import jobs
from lumenframe.catalog import Catalog, CatalogError
from lumenframe.functions import text as T
from lumenframe.storage import shuffles_dropped

TABLES = tuple(f.name for f in fields(Catalog))
_BUCKET = "in_bucket"
_WHOLE = ""


class VersionConflict(CatalogError):
    """Other writers were faster each time."""


def _path_key(name: str) -> Column:
    return T.normalize_path(F.col("file_path")) if name == "features" else F.col("path_key")


class Store:
    """Versions of a catalogue below ``root``; ``buckets`` is fixed when the first is written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # files
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, place = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """``version, buckets, notes, tables``; the newest one by default."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise CatalogError(f"no version {version if version is not None else ''} below {self.root}")
        path = f"{self.root}/versions/{known[-1] if version is None else version:08d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> bool:
        """False if the number is taken."""
        jobs.check()
        fs, jvm, name = self._fs(), self.spark._jvm, f"versions/{manifest['version']:08d}.json"
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(self._path("versions"))
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self._path(name), how)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            fs.delete(draft, False)
            return False
        return True

    # tables
    def _write(self, attempt: str, name: str, df: DataFrame, buckets: int) -> dict[str, str]:
        """Folders of the written rows by bucket; a large bucket is several files."""
        jobs.check()
        folder = f"data/{attempt}/{name}"
        with shuffles_dropped(self.spark):
            if name not in ("media", "faces", "features"):
                df.write.parquet(f"{self.root}/{folder}")
                return {_WHOLE: folder}
            rows = df.withColumn(_BUCKET, F.pmod(F.xxhash64(_path_key(name)), F.lit(buckets)))
            rows.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{_BUCKET}=")}

    def _read(self, manifest: dict, touched: set[str] | None) -> Catalog:
        out = {}
        for name, table in manifest["tables"].items():
            schema = StructType.fromJson(table["schema"])
            folders = [f"{self.root}/{p}" for b, p in table["folders"].items() if touched is None or b in touched or b == _WHOLE]
            out[name] = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return Catalog(**out)

    # use
    def create(self, c: Catalog) -> int:
        """Write the first version."""
        attempt, tables = uuid.uuid4().hex, {}
        for name in TABLES:
            df = getattr(c, name)
            tables[name] = {"schema": df.schema.jsonValue(), "folders": self._write(attempt, name, df, self.buckets)}
        if not self._publish({"version": 0, "buckets": self.buckets, "notes": {}, "tables": tables}):
            raise VersionConflict(f"{self.root} has versions already")
        return 0

    def load(self, version: int | None = None) -> Catalog:
        return self._read(self.manifest(version), None)

    def change(self, change: Callable[[Catalog], Catalog], keys: DataFrame | None = None, notes: dict | None = None, attempts: int = 5) -> int:
        """Publish what ``change`` makes of the newest version; returns the new version's number.

        ``keys`` (``file_path``) says that the change reads and writes rows of
        these files only; it then sees the buckets of these files, and other
        buckets are kept as they are.  Tables that it returns as they were are
        kept too.  ``notes`` are kept with the version.
        """
        for _ in range(attempts):
            last = self.manifest()
            touched = None
            if keys is not None:
                at = F.pmod(F.xxhash64(T.normalize_path(F.col("file_path"))), F.lit(last["buckets"]))
                touched = {str(r.b) for r in keys.select(at.alias("b")).distinct().collect()}  # as many as buckets
            before = self._read(last, touched)
            after, attempt, tables = change(before), uuid.uuid4().hex, dict(last["tables"])
            try:
                for name in TABLES:
                    df = getattr(after, name)
                    if df is getattr(before, name):
                        continue
                    written = self._write(attempt, name, df, last["buckets"])
                    kept = {}
                    if touched is not None and _WHOLE not in written and name in ("media", "faces", "features"):
                        if not set(written) <= touched:
                            raise CatalogError(f"a change of {name} reaches files that are not among its keys")
                        kept = {b: p for b, p in last["tables"][name]["folders"].items() if b not in touched}
                    tables[name] = {"schema": df.schema.jsonValue(), "folders": kept | written}
                fresh = {**last, "version": last["version"] + 1, "notes": last["notes"] | (notes or {}), "tables": tables}
                if self._publish(fresh):
                    return fresh["version"]
            except BaseException:
                self._fs().delete(self._path(f"data/{attempt}"), True)
                raise
            self._fs().delete(self._path(f"data/{attempt}"), True)
        raise VersionConflict(f"{attempts} attempts below {self.root}")

    def expire(self, keep: int = 2) -> list[int]:
        """Forget all but the newest ``keep`` versions, and delete folders that only those named."""
        known = self.versions()
        old, rest = known[: max(0, len(known) - max(1, keep))], known[-max(1, keep) :]
        folders = lambda v: {p for t in self.manifest(v)["tables"].values() for p in t["folders"].values()}
        gone = set().union(*map(folders, old)) - set().union(*map(folders, rest)) if old else set()
        for version in old:
            self._fs().delete(self._path(f"versions/{version:08d}.json"), False)
        for folder in gone:
            self._fs().delete(self._path(folder), True)
        return old
