"""Tables of committed versions, for sinks that merge what they hold with a batch.

A commit writes new files for the parts that a batch touches, and then one manifest, which names the files of every part, the last
batch of each writer and a cursor; it is renamed into place, so it is there whole or not at all. Readers follow the last manifest
and never see files of a commit that failed; a batch that its manifest names already is left alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Hash parts of a table, or of each month of one that has a time.
PARTS = 64


def part_of(keys: Sequence[str], time: str | None = None, parts: int = PARTS) -> Column:
    """Part of a row by its keys and, with time, its month."""
    hashed = F.lpad(F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string"), 4, "0")
    return hashed if time is None else F.concat(F.coalesce(F.date_format(time, "yyyyMM"), F.lit("none")), F.lit("-"), hashed)


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, writer: str = "sink"):
        self.spark, self.path, self.writer = spark, path.rstrip("/"), writer
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def manifest(self) -> dict | None:
        """The last commit: version, schema, parts (file folder and version of each), batches of writers, cursor."""
        names = sorted(n for n in self._names("commits") if n.endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/commits/{names[-1]}", wholetext=True).first()[0]) if names else None

    def read(self, parts: Sequence[str] | None = None, newer_than: int = -1) -> DataFrame | None:
        """The table, or some of its parts, or what commits after a version wrote anew; None before the first commit."""
        last = self.manifest()
        if last is None:
            return None
        schema = StructType.fromJson(last["schema"])
        folders = [f"{self.path}/{p['folder']}" for name, p in last["parts"].items() if (parts is None or name in parts) and p["version"] > newer_than]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def has(self, batch: int) -> bool:
        last = self.manifest()
        return last is not None and last["batches"].get(self.writer, -1) >= batch

    def commit(self, rows: DataFrame, touched: Sequence[str], batch: int, cursor: int | None = None) -> None:
        """rows, with their part, become all that the touched parts hold; the other parts stay."""
        last = self.manifest() or {"version": -1, "parts": {}, "batches": {}, "cursor": None}
        version = last["version"] + 1
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        rows.repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        parts = {name: p for name, p in last["parts"].items() if name not in set(touched)}
        parts |= {n.removeprefix("part="): {"folder": f"{folder}/{n}", "version": version} for n in self._names(folder) if n.startswith("part=")}
        schema = json.loads(rows.drop("part").schema.json())
        self._publish({"version": version, "schema": schema, "parts": parts, "batches": last["batches"] | {self.writer: batch}, "cursor": last["cursor"] if cursor is None else cursor})

    def _publish(self, manifest: dict) -> None:
        """Renames the manifest to its version's name; another commit of that version makes this one fail, to be run again."""
        hidden, name = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{manifest['version']:012d}.json")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(hidden, name, none)

    def expire(self, keep: int = 10) -> None:
        """Deletes manifests but the last ones, and folders that none of those names. Not beside a commit that runs."""
        names = sorted(n for n in self._names("commits") if n.endswith(".json"))
        used = set()
        for n in names[-keep:]:
            used |= {p["folder"].split("/")[1] for p in json.loads(self.spark.read.text(f"{self.path}/commits/{n}", wholetext=True).first()[0])["parts"].values()}
        for n in names[:-keep]:
            self._fs.delete(self._at(f"commits/{n}"), False)
        for n in self._names("data"):
            if n not in used:
                self._fs.delete(self._at(f"data/{n}"), True)


def merge_into(table: CommittedTable, batch: DataFrame, part: Column, merge: Callable[[DataFrame | None, DataFrame], DataFrame], batch_id: int, cursor: int | None = None) -> None:
    """Commits merge(what the touched parts hold, batch), once for a batch_id; a batch without rows commits its cursor at most."""
    if table.has(batch_id):
        return
    keyed = batch.withColumn("part", part).persist()  # read twice
    try:
        touched = [r[0] for r in keyed.select("part").distinct().collect()]  # parts of the table
        if touched or cursor is not None:
            before = table.read(touched)
            merged = merge(before, keyed.drop("part")) if touched else before if before is not None else keyed.drop("part")
            table.commit(merged.withColumn("part", part), touched, batch_id, cursor)
    finally:
        keyed.unpersist()
