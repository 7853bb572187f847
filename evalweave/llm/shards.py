"""Sharding with size-tiered compaction and versioned manifests.

A sharded table is a folder: ``data/`` holds immutable Parquet shards, ``manifest-N.json`` says what version N adds to and drops from the one before; every :data:`FULL_EVERY`-th lists all.
An arrival is appended as small shards.
Shards are of tier t when their size lies within a factor of ``fanout`` of ``floor * fanout**t``; once ``fanout`` shards of one tier have gathered, that run is merged into files
of about the target size, which replace it in a new manifest. So a row is rewritten once a tier, about log(target / floor) times at most, however many arrivals come.
Merging reads whole shards and writes whole files without a shuffle; the runs of a round merge side by side; sizes come from file metadata.

Commit: a writer writes its manifest under a name of its own and then gives it the name of version N + 1, which the file system lets one writer do: by a hard link on a
mounted folder, by a rename that refuses an existing name on HDFS. The other writer gets an error and starts again from the new version. There is nothing to recover: a writer that dies leaves at most
files that no version lists, which :meth:`ShardedTable.vacuum` deletes. Object stores have neither operation, and are refused.

Cases: an empty arrival commits a version without new shards, and a table of nothing else reads as no rows; null and repeated rows are kept as they are; columns are those of the first arrival, another schema is refused; a table
without any version has no columns and can't be read. :func:`shard_documents` replaces columns of the input named like those that it adds; other columns ride along whatever their names.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalweave.llm.common import columns, free_name, others

FLOOR_BYTES = 1 << 20
TARGET_BYTES = 64 << 20
FANOUT = 4
FULL_EVERY = 16
#: Runs that merge at a time; each is a Spark job of its own.
MERGES = 4
SCHEMES = ("file", "hdfs", "viewfs", "webhdfs")


class ShardedTable:
    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET_BYTES, fanout: int = FANOUT, floor: int = FLOOR_BYTES):
        self.spark, self.folder, self.target, self.fanout, self.floor = spark, folder.rstrip("/"), target, fanout, floor
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.scheme = self.fs.getUri().getScheme()
        if self.scheme not in SCHEMES:
            raise ValueError(f"a sharded table needs a file system that names a file once; {self.scheme} doesn't")
        self.fs.mkdirs(self._path(f"{self.folder}/data"))

    # manifests

    def version(self) -> int:
        """The highest committed version; 0 before the first."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return max([0, *(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))])

    def _manifest(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"{self.folder}/manifest-{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and all shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        chain = [self._manifest(version)]
        while not chain[-1]["full"]:
            chain.append(self._manifest(chain[-1]["version"] - 1))
        shards: dict[str, dict] = {}
        for m in reversed(chain):
            for path in m["drop"]:
                shards.pop(path)
            shards |= {s["path"]: s for s in m["add"]}
        return {"version": version, "schema": chain[0]["schema"], "shards": list(shards.values())}

    def commit(self, base: dict, schema: str | None, add: list[dict], drop: list[dict] = ()) -> int:
        """Make the shards of ``base``, without ``drop`` and with ``add``, the next version; fails if another writer has made one."""
        version, full, gone = base["version"] + 1, base["version"] % FULL_EVERY == 0, {s["path"] for s in drop}
        if full:
            add, gone = [*(s for s in base["shards"] if s["path"] not in gone), *add], set()
        temp, name = f"{self.folder}/.manifest-{uuid.uuid4().hex}", f"{self.folder}/manifest-{version}.json"
        stream = self.fs.create(self._path(temp), False)
        stream.write(bytearray(json.dumps({"version": version, "schema": schema, "full": full, "add": add, "drop": sorted(gone)}).encode()))
        stream.close()
        if not self._name(temp, name):
            self.fs.delete(self._path(temp), False)
            raise RuntimeError(f"version {version} is another writer's")
        return version

    def _name(self, temp: str, name: str) -> bool:
        """Give a finished file its name, unless the name is taken."""
        if self.scheme != "file":
            return self.fs.rename(self._path(temp), self._path(name))
        local = lambda p: self.spark._jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
        try:
            self.spark._jvm.java.nio.file.Files.createLink(local(name), local(temp))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        self.fs.delete(self._path(temp), False)
        return True

    # shards

    def _files(self, path: str) -> list[dict]:
        """Path and bytes of each data file below ``path``."""
        found, out = self.fs.listFiles(self._path(path), True), []
        while found.hasNext():
            s = found.next()
            if s.getPath().getName().endswith(".parquet") and s.getLen():
                out.append({"path": s.getPath().toString(), "bytes": s.getLen()})
        return sorted(out, key=lambda f: f["path"])

    def append(self, arrival: DataFrame) -> int:
        """One arrival as small shards, one version."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        arrival.write.parquet(path)
        return self._list(arrival.schema, self._files(path))

    def append_runs(self, rows: DataFrame, arrival_col: str) -> list[int]:
        """Many arrivals that lie in one table, told apart by a column, which is not kept: written in one pass, committed one by one. Without a row, one version without new shards."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.partitionBy(arrival_col).parquet(path)
        runs: dict[str, list[dict]] = {}
        for f in self._files(path):
            runs.setdefault(f["path"].rsplit("/", 2)[1], []).append(f)
        schema = StructType([f for f in rows.schema if f.name != arrival_col])
        return [self._list(schema, files) for _, files in sorted(runs.items())] or [self._list(schema, [])]

    def _list(self, schema: StructType, files: list[dict]) -> int:
        now = self.manifest()
        known = StructType.fromJson(json.loads(now["schema"])) if now["schema"] else schema
        if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in schema]:
            raise ValueError("an arrival needs the table's columns")
        return self.commit(now, known.json(), files)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.floor, self.fanout)))

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """Shards of one tier, below the target size, that are enough to merge."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] * 2 <= self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fanout]

    def _merge(self, schema: str, run: list[dict]) -> list[dict]:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        self._scan(schema, run).coalesce(max(1, round(sum(s["bytes"] for s in run) / self.target))).write.parquet(path)
        return self._files(path)

    def compact(self) -> int:
        """Merge until no tier holds a whole run; the version that this leaves."""
        while runs := self.runs((now := self.manifest())["shards"]):
            with ThreadPoolExecutor(MERGES) as pool:
                fresh = [s for files in pool.map(lambda run: self._merge(now["schema"], run), runs) for s in files]
            self.commit(now, now["schema"], fresh, [s for run in runs for s in run])
        return self.version()

    def vacuum(self, keep_from: int) -> int:
        """Delete shards that no version from ``keep_from`` on lists; how many. Not while somebody appends: what a writer has yet to list would go."""
        listed = {s["path"] for v in range(max(1, keep_from), self.version() + 1) for s in self.manifest(v)["shards"]}
        gone = [f["path"] for f in self._files(f"{self.folder}/data") if f["path"] not in listed]
        for path in gone:
            self.fs.delete(self._path(path), False)
        return len(gone)

    def _scan(self, schema: str, shards: list[dict]) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[s["path"] for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """A snapshot, as of a version."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("a table without arrivals has no columns")
        if not now["shards"]:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(now["schema"])))
        return self._scan(now["schema"], now["shards"])


def shard_documents(docs: DataFrame, folder: str, arrivals: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Append ``docs`` in ``arrivals`` runs dealt by id hash, compact, and read the last version: its rows with shard (file), shard_bytes and version."""
    spark = docs.sparkSession
    out = ShardedTable(spark, folder)
    kept = others(docs.columns, ["shard", "shard_bytes", "version"])
    arrival = free_name("arrival", docs.columns)
    out.append_runs(docs.select(*columns(kept), F.pmod(F.xxhash64(*columns([id_col])), F.lit(arrivals)).alias(arrival)), arrival)
    version = out.compact()
    out.vacuum(version)
    rows = out.read(version)
    if not out.manifest(version)["shards"]:
        return rows.select(*columns(kept), F.lit(None).cast("string").alias("shard"), F.lit(None).cast("long").alias("shard_bytes"), F.lit(version).alias("version"))
    file = rows.metadataColumn("_metadata")  # the file's own, whatever columns documents have
    return rows.select(*columns(kept), file.getField("file_name").alias("shard"), file.getField("file_size").alias("shard_bytes"), F.lit(version).alias("version"))
