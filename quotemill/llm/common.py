"""Helpers that several operators share: reading a table, cutting lineage, text defaults."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, may do without and gets a fresh
    folder of its own; anywhere else it would be one that other executors can't read."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quotemill-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors, no lineage behind it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: unlike a checkpoint it is columnar and compressed."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: whatever their names, they can't clash with those that an operator adds beside it."""
    return F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, to tell rows apart that are alike in what an operator looks at; maps count by their JSON."""
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


_SPACE = re.compile("[ \t-\r]")


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Parts of about size characters, cut before white space; a stretch without any stays whole."""
    at = 0
    while len(text) - at > size:
        space = _SPACE.search(text, at + size)
        if not space:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 text with A-Z lower-cased: bytes.split() and bytes.lower() know ASCII only."""
    return text.lower().split()
