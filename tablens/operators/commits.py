"""Tables as Parquet parts under a commit log.

A writer puts its rows into folders of its own and makes them visible by one log entry, the file of the next version.
The entry is written aside and renamed without overwriting, so of two writers of one version exactly one succeeds and the
other goes on from the log it then sees; neither loses the other's rows. (The file system's rename must refuse an existing target in one step, as
HDFS and its like do.) Deletes are tombstones in the entry and are merged on read: a key is gone from all parts committed before it.
A batch carries its source's number; a number that the log has seen is not applied again.
The log holds names and keys, one small entry a commit; rows never pass the driver.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "adds map<string, array<string>>, deletes map<string, array<string>>, batch struct<source: string, number: long>"


class Conflict(Exception):
    """Another writer has committed the version."""


class CommitLog:
    """``keys`` names the key column of every table that deletes may touch."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, str]):
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys

    # ---------------------------------------------------------------- the log
    def _fs(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.root}/_log")
        return jvm, path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[tuple[int, dict]]:
        """(version, entry) in order."""
        _, path, fs = self._fs()
        if not fs.exists(path):
            return []
        rows = self.spark.read.schema(_ENTRY).option("pathGlobFilter", "*.json").json(f"{self.root}/_log").select(
            F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("int").alias("version"), "*").collect()
        return sorted(((r["version"], r.asDict(recursive=True)) for r in rows), key=lambda e: e[0])

    def version(self) -> int:
        """The last version, 0 before the first commit."""
        _, path, fs = self._fs()
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def commit(self, version: int, adds: dict[str, list[str]], deletes: dict[str, list[str]] | None = None,
               batch: tuple[str, int] | None = None) -> None:
        """Entry number ``version``; raises ``Conflict`` where it exists."""
        jvm, folder, fs = self._fs()
        fs.mkdirs(folder)
        entry = {"adds": adds, "deletes": deletes or {}, "batch": {"source": batch[0], "number": batch[1]} if batch else None}
        aside, name = jvm.Path(folder, f".{uuid.uuid4().hex}.tmp"), jvm.Path(folder, f"{version:020d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(
            self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            jvm.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, name, none)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(version) from None
            raise

    def seen(self, batch: tuple[str, int]) -> bool:
        """Whether the log holds this source's batch number or a later one."""
        return any(e["batch"] and e["batch"]["source"] == batch[0] and e["batch"]["number"] >= batch[1] for _, e in self.entries())

    # ---------------------------------------------------------------- parts
    def part(self, table: str, rows: DataFrame) -> str:
        """Rows written to a folder of their own (not visible yet); its name."""
        name = uuid.uuid4().hex
        rows.select(*[c.split()[0] for c in self._columns(table)]).write.parquet(f"{self.root}/{table}/{name}")
        return name

    def _columns(self, table: str) -> list[str]:
        return [f"{f.name} {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], self.schemas[table]).schema.fields]

    def read(self, table: str, version: int | None = None, with_deleted: bool = False) -> DataFrame:
        """The rows of a table as of a version, with ``_version``, the commit that added them: all visible parts in one scan, without
        the rows whose key was deleted after they were added (unless they are asked for)."""
        log = [(v, e) for v, e in self.entries() if version is None or v <= version]
        added = [(name, v) for v, e in log for name in (e["adds"] or {}).get(table, [])]
        if not added:
            return self.spark.createDataFrame([], self.schemas[table]).withColumn("_version", F.lit(None).cast("int"))
        rows = self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.root}/{table}/{name}" for name, _ in added])
        part = F.element_at(F.split("_metadata.file_path", "/"), -2).alias("_part")
        versions = self.spark.createDataFrame(added, "_part string, _version int")
        rows = rows.select("*", part).join(F.broadcast(versions), "_part").drop("_part")        # one row a commit
        gone = [(key, v) for v, e in log for key in (e["deletes"] or {}).get(table, [])]
        if gone and not with_deleted:
            stones = self.spark.createDataFrame(gone, "_key string, _gone int").groupBy("_key").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(stones, (F.col(self.keys[table]).cast("string") == F.col("_key")) & (F.col("_gone") > F.col("_version")), "left_anti")
        return rows

    # ---------------------------------------------------------------- writers
    def append(self, parts: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """Adds rows that need nothing of what is there; false where the batch was applied before. A taken version is tried again as the next."""
        adds = {table: [self.part(table, rows)] for table, rows in parts.items()}
        return self._until_committed(lambda _: (adds, None), batch)

    def delete(self, keys: dict[str, list[str]]) -> bool:
        """One entry that takes the keys out of their tables."""
        return self._until_committed(lambda _: ({}, keys), None)

    def update(self, make: Callable[[int], dict[str, DataFrame]], batch: tuple[str, int] | None = None) -> bool:
        """Adds what ``make`` makes from the tables as of a version, and only right behind that version: where another writer was
        first, it is made again."""
        return self._until_committed(lambda v: ({t: [self.part(t, rows)] for t, rows in make(v).items()}, None), batch)

    def _until_committed(self, make: Callable, batch: tuple[str, int] | None) -> bool:
        while True:
            version = self.version()
            if batch and self.seen(batch):
                return False
            adds, deletes = make(version)
            try:
                self.commit(version + 1, adds, deletes, batch)
                return True
            except Conflict:
                continue


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key from its last commit."""
    plain = [c for c in rows.columns if c != "_version"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*plain), "_version").alias("row")).select("row.*")
