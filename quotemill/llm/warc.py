"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their id and payload digest, with the same payload bytes in each; a task writes a
shard in that order, rolls files by compressed size, makes headers and digests anew, and commits each shard by renaming its
files from temporary names, then its manifest. A task that is run again writes the same bytes over the same names, and
readers take only files that a manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.llm.common import fresh_path, written

#: Compressed bytes after which a file is closed, and payload bytes that a shard holds.
ROLL_BYTES = 32 << 20
SHARD_BYTES = 32 << 20
#: Bounds of shards at most, 28 bytes each: what is broadcast. Beyond it shards hold more, half a gigabyte at 100 TB.
MAX_SHARDS = 200_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uuid(page_id: int | None, copy: int, payload_digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"record:{page_id}:{copy}:{payload_digest}"))


def _header_value(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, copy: int, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; that of a revisit has the HTTP head alone, and names the response's page."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_uuid(page_id, copy, sha1)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{digest32(block)}", f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(base: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:/") else (fs.LocalFileSystem(), base)


class _Shard:
    """Files of one shard; each record is its own gzip member, as readers of single records need."""

    def __init__(self, base: str, shard: int, roll: int):
        (self.store, self.base), self.shard, self.roll = _store(base), shard, roll
        self.tag, self.files, self.out, self.size = f"{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}", [], None, 0
        self.store.create_dir(self.base, recursive=True)

    def _temporary(self, name: str) -> str:
        return f"{self.base}/.tmp-{self.tag}-{name}"

    def add(self, data: bytes) -> None:
        if self.out is None:
            name = f"part-{self.shard:06d}-{len(self.files):04d}.warc.gz"
            self.files.append({"name": name, "records": 0, "bytes": 0})
            self.out, self.size = self.store.open_output_stream(self._temporary(name), compression=None), 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.size += len(packed)
        self.files[-1]["records"] += 1
        self.files[-1]["bytes"] += len(packed)
        if self.size >= self.roll:
            self._close()

    def _close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def commit(self) -> dict:
        self._close()
        for f in self.files:
            self.store.move(self._temporary(f["name"]), f"{self.base}/{f['name']}")
        name = f"part-{self.shard:06d}.manifest.json"
        with self.store.open_output_stream(self._temporary(name), compression=None) as out:
            out.write(json.dumps({"shard": self.shard, "files": self.files}, sort_keys=True).encode())
        self.store.move(self._temporary(name), f"{self.base}/{name}")
        return {"shard": self.shard, "files": self.files}


def digests(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page_id, payload_sha1, bytes) of each row, as a small table that bounds and revisits are made from."""
    return written(pages.select(F.col(key).alias("page_id"), F.sha1(F.encode(html, "utf-8")).alias("payload_sha1"), F.octet_length(html).cast("long").alias("bytes")), "digests")


def shard_bounds(digested: DataFrame, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> np.ndarray:
    """The first place (see places) of each shard but the first, ascending: rows in the order of id and digest are parted where
    the sum of their bytes passes a multiple of shard_bytes (more, where that made over max_shards).

    Sums run within range partitions of small rows, on top of the sums of the partitions before; rows that share id and digest
    are one place and stay together, others of an id may part.
    """
    total = digested.agg(F.sum("bytes")).first()[0] or 0
    size = max(shard_bytes, -(-total // max_shards))
    if total <= size:
        return np.zeros(0, _PLACE)
    spark = digested.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal places first become one row, so a place that a third of all rows have is one
    once = digested.groupBy("page_id", "payload_sha1").agg(F.sum("bytes").alias("bytes"))
    order = (F.asc_nulls_first("page_id"), F.asc("payload_sha1"))
    placed = written(once.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "places")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = placed.groupBy("part").agg(F.sum("bytes").alias("b")).select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"))
    sums = placed.join(F.broadcast(bases), "part").withColumn("end", F.col("base") + F.sum("bytes").over(Window.partitionBy("part").orderBy(*order)))
    shard = F.expr(f"(end - bytes) div {size}")
    first = sums.groupBy(shard.alias("shard")).agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "payload_sha1")).alias("f"))
    rows = first.where("shard > 0").select("f.page_id", "f.payload_sha1").toPandas()  # max_shards rows at most
    return np.sort(places(rows["page_id"], rows["payload_sha1"]))


#: Compressed bytes that a task reads, on average.
TASK_BYTES = 16 << 20
_PLACE = "S29"


def places(ids: pd.Series, sha1: pd.Series) -> np.ndarray:
    """Id and digest as bytes in their order: a flag that puts null ids first, the id, the digest. The flag is never zero, nor is
    what is cut from the end of such bytes told from zeros: digests of one length keep their order."""
    known = ids.notna().to_numpy()
    out = np.empty((len(ids), 29), np.uint8)
    out[:, 0] = 1 + known
    out[:, 1:9] = (ids.fillna(0).astype("int64").to_numpy().astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = np.frombuffer(bytes.fromhex("".join(sha1)), np.uint8).reshape(-1, 20)
    return out.view(_PLACE).ravel()


def revisits(digested: DataFrame, min_bytes: int = 0) -> DataFrame:
    """digested(page_id, payload_sha1, bytes) -> (page_id, payload_sha1, refers_to) of the pages whose payload, of at least
    min_bytes, a lesser id has: refers_to is the least.

    Payloads aren't moved: their digests meet as one row for each digest and map task; a digest that a third of the pages have
    is a skewed side of a join of small rows, which Spark splits.
    """
    big = digested.where(F.col("bytes") >= min_bytes).select("page_id", "payload_sha1")
    first = big.groupBy("payload_sha1").agg(F.min("page_id").alias("refers_to"))
    # of rows with the same id and payload, all are what the first is
    return big.join(first, "payload_sha1").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_sha1", "refers_to").distinct()


def write_warc(pages: DataFrame, base: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes pages as WARC files under base, a folder all executors share; returns the table of the shards' manifests, a JSON text each,
    which is kept under base too: names of files never pass through the driver.

    Payload is the html in UTF-8; null url and html count as empty. Of equal payloads of at least min_bytes, the one with the
    least id is the response, the others revisit it. A null id sorts first, and is a response only if no other row has its
    payload's digest with an id. Of rows that share the least id and payload, all are responses; such rows are all in one shard,
    whose task streams them and rolls its files. An empty table writes nothing. Other columns don't matter.
    """
    slim = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digested = digests(slim, "page_id", "html")
    bounds = shard_bounds(digested, shard_bytes)
    shards = len(bounds) + 1
    shared = pages.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, sha1: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, places(ids, sha1), "right").astype(np.int32))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Shard | None = None
        made: list[dict] = []
        last, copy, told = None, 0, (None, None, None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["refers_to"] is not None:  # stands before the pages of its id and payload
                    told = row["page_id"], row["payload_sha1"], row["refers_to"]
                    continue
                if out is None or out.shard != row["shard"]:
                    made += [out.commit()] if out else []
                    out, last = _Shard(base, row["shard"], roll_bytes), None
                refers_to = told[2] if told[:2] == (row["page_id"], row["payload_sha1"]) else None
                payload = row["html"].encode("utf-8", "surrogatepass")
                sha1 = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
                copy = copy + 1 if (row["page_id"], sha1) == last else 0
                last = row["page_id"], sha1
                out.add(record(row["page_id"], copy, row["url"], payload, sha1, refers_to))
        made += [out.commit()] if out else []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(m, sort_keys=True) for m in made])], names=["manifest"])

    whole = slim.withColumn("payload_sha1", F.sha1(F.encode("html", "utf-8"))).withColumn("refers_to", F.lit(None).cast("long"))
    both = whole.unionByName(revisits(digested, min_bytes), allowMissingColumns=True).withColumn("shard", shard_of("page_id", "payload_sha1"))
    # a shard is bounded in bytes, so a task holds one or a few whole; payloads are moved once
    order = ("shard", F.asc_nulls_first("page_id"), "payload_sha1", F.desc_nulls_last("refers_to"), "url")
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)
    dealt.mapInArrow(write, "manifest string").write.parquet(f"{base}/_manifests")
    return pages.sparkSession.read.schema("manifest string").parquet(f"{base}/_manifests")


def _records(stream: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member."""
    unpack, held = zlib.decompressobj(31), bytearray()
    data = stream.read(_CHUNK)
    while data:
        held += unpack.decompress(data)
        if unpack.eof:
            head, _, rest = bytes(held).partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines)
            n = int(headers["Content-Length"])
            if not version.startswith("WARC/1.") or len(rest) != n + 4 or f"sha1:{digest32(rest[:n])}" != headers["WARC-Block-Digest"]:
                raise ValueError("damaged WARC record")
            yield headers, rest[:n]
            data, unpack, held = unpack.unused_data or stream.read(_CHUNK), zlib.decompressobj(31), bytearray()
        else:
            data = stream.read(_CHUNK)


def read_warc(spark: SparkSession, base: str, manifests: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per record of the files that manifests list: page_id, url, record_type, payload_digest, payload_bytes, refers_to,
    payload (null for a revisit). Every block's digest is checked, and every response's payload against its own. Records
    without an id have a null page_id, repeated records are as many rows, no files none."""
    files = manifests.select(F.explode(F.from_json("manifest", "files array<struct<name:string,bytes:long>>")["files"]).alias("f")).select("f.*")
    # files are dealt to as many tasks as their bytes need
    tasks = -(-(files.agg(F.sum("bytes")).first()[0] or 1) // task_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(base)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in _records(stream):
                        kind = h["WARC-Type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and (f"sha1:{digest32(payload)}" != h["WARC-Payload-Digest"] or len(payload) != int(h["X-Payload-Length"])):
                            raise ValueError("a payload doesn't match its digest")
                        page, to = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        rows.append({"page_id": int(page) if page else None, "url": h["WARC-Target-URI"], "record_type": kind, "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(h["X-Payload-Length"]), "refers_to": int(to) if to else None, "payload": payload})
                        held += len(block)
                        if held >= 8 * _CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return files.select("name").repartition(tasks, "name").mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def archive(spark: SparkSession, pages: DataFrame, **settings: int) -> DataFrame:
    """pages written to a fresh folder of the shared space, and read back: a row for each row, nulls, repeats and all, as
    write_warc says; none for an empty table."""
    base = fresh_path(spark, "warc")
    return read_warc(spark, base, write_warc(pages, base, **settings))
