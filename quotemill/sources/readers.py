"""Readers of tables, packages, archives and provider payloads; sinks."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import clamp_delta

PACKAGE_HEADER = "timestamp_utc,open,high,low,close,volume,price_side,source"
PACKAGE_SCHEMA = "timestamp_utc string, open string, high string, low string, close string, volume string, price_side string, source string"
#: A record of a bar archive: seconds, prices in millionths, volume; little-endian, 48 bytes.
ARCHIVE = np.dtype([("t", "<i8"), ("high", "<i8"), ("open", "<i8"), ("low", "<i8"), ("close", "<i8"), ("volume", "<i8")])


def read_quotes(spark: SparkSession, path: str, instrument: str | None = None, channel: str | None = None, start=None, end=None, time: str = "observed_at") -> DataFrame:
    """Ticks of a table in [start, end) of an instrument and channel, each bound if it's given: filters that reach the scan."""
    df = spark.read.parquet(path)
    for name, value in (("instrument", instrument), ("channel", channel)):
        df = df if value is None else df.where(F.col(name) == value)
    df = df if start is None else df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    return df if end is None else df.where(F.col(time) < F.lit(end).cast("timestamp"))


def read_bars(spark: SparkSession, path: str, instrument: str | None = None, start=None, end=None) -> DataFrame:
    """Bars of a table, as read_quotes, by their opening."""
    return read_quotes(spark, path, instrument, None, start, end, "open_time")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)


def write_period_bars(df: DataFrame, path: str, partitions: Sequence[str] = ("instrument", "period")) -> None:
    """Overwrites the partitions that df has rows of; others stay. A bucket that became empty goes, as its partition is written
    from all bars it has now."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def numbered_lines(spark: SparkSession, root: str) -> DataFrame:
    """file, row_number (from 0 in each file) and line of text files, however many splits a file is read in; blank lines at the end of
    a file are none, and neither is a carriage return at the end of a line.

    A split's lines are in one partition, one after the other; counts of the splits before make their places there numbers of
    the file.
    """
    raw = spark.read.option("lineSep", "\n").text(root)
    lines = raw.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.rtrim("value", F.lit("\r")).alias("line"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.max(F.when(F.col("line") != "", F.col("_at"))).alias("_full"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_n")
    splits = splits.withColumn("_before", before)
    splits = splits.withColumn("_end", F.max(F.col("_full") - F.col("_first") + F.col("_before")).over(Window.partitionBy("_path")))
    met = lines.join(splits.select("_path", "_block", "_first", "_before", "_end"), ["_path", "_block"])
    return met.withColumn("row_number", F.col("_at") - F.col("_first") + F.col("_before")).where("row_number <= _end").select("_path", "file", "row_number", "line")


def read_bar_package(spark: SparkSession, root: str, price_side: str = "bid") -> DataFrame:
    """CSV files of one-minute bars with an exact header: bars with row number and sha256 of each line. A line that doesn't parse,
    another price side or header is an error."""
    lines = numbered_lines(spark, root)
    checked = lines.withColumn("line", F.when((F.col("row_number") == 0) & (F.col("line") != PACKAGE_HEADER), F.raise_error(F.concat(F.lit("header of "), "file"))).otherwise(F.col("line")))
    rows = checked.where("row_number > 0 or line is null").select("file", F.col("row_number").cast("int").alias("row_number"), F.sha2("line", 256).alias("line_sha256"), F.from_csv("line", PACKAGE_SCHEMA, {"mode": "FAILFAST"}).alias("r"))
    ok = F.when(F.col("r.price_side") != price_side, F.raise_error(F.concat(F.lit("price side in "), "file"))).otherwise(F.col("r.price_side"))
    return rows.select(
        "file", "row_number", "line_sha256", F.to_timestamp("r.timestamp_utc").alias("open_time"), *(F.col(f"r.{c}").cast("decimal(20,8)").alias(c) for c in ("open", "high", "low", "close", "volume")),
        F.col("r.close").alias("close_text"), ok.alias("price_side"), F.col("r.source").alias("source"))


def verify_artifacts(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """manifest(path, bytes, sha256) with verified: is the file of that path under root there with this length and digest?"""
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = F.length(bare(F.lit(root.rstrip("/")))) + 2
    have = files.select(F.substr(bare("path"), folder).alias("_p"), F.length("content").cast("long").alias("_n"), F.sha2("content", 256).alias("_h"))
    j = manifest.join(have, F.col("_p") == F.col("path"), "left")
    return j.withColumn("verified", F.coalesce((F.col("_n") == F.col("bytes")) & (F.col("_h") == F.lower("sha256")), F.lit(False))).drop("_p", "_n", "_h")


def read_vol_history(spark: SparkSession, path: str, code: str) -> DataFrame:
    """History of a volatility index, a file or several: the value is CLOSE, or a column named as the index; dates MM/dd/yyyy; blanks
    are left out; of one date the last line counts. A file without those columns is an error."""
    lines = numbered_lines(spark, path)
    names = F.transform(F.split("line", ","), lambda c: F.upper(F.trim(c)))
    heads = lines.where("row_number = 0").select(F.col("_path").alias("_of"), names.alias("_names"))  # a row a file
    at = lambda name: F.array_position("_names", name) - 1
    value = F.when(at("CLOSE") >= 0, at("CLOSE")).otherwise(at(code.upper()))
    checked = F.when((at("DATE") < 0) | (value < 0), F.raise_error(F.concat(F.lit("no DATE and value column in "), F.array_join("_names", ",")))).otherwise(value)
    heads = heads.select("_of", at("DATE").cast("int").alias("_date"), checked.cast("int").alias("_value"))
    field = lambda c: F.trim(F.get(F.split("line", ","), F.col(c)))
    rows = lines.where("row_number > 0").join(heads, F.col("_path") == F.col("_of")).select(
        F.try_to_timestamp(field("_date"), F.lit("MM/dd/yyyy")).cast("date").alias("date"), F.try_to_number(field("_value"), F.lit("999999999.999999")).cast("double").alias("value"), F.struct("_path", "row_number").alias("_n"))
    return rows.where("date is not null and value is not null").groupBy("date").agg(F.max_by("value", "_n").alias("value")).select(F.lit(code).alias("code"), "date", "value")


def normalize_vol_quotes(df: DataFrame, json: str = "json") -> DataFrame:
    """{symbol, data: {current_price, last_trade_time}} -> code, value, observed_at; times without an offset are Chicago's."""
    j = df.select(F.from_json(json, "symbol string, data struct<symbol:string,current_price:double,last_trade_time:string>").alias("j")).select("j.*")
    bare = F.regexp_replace(F.coalesce("symbol", "data.symbol"), r"^[_^]", "")
    t = F.col("data.last_trade_time")
    at = F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(t)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(t), "America/Chicago"))
    return j.select(bare.alias("code"), F.col("data.current_price").alias("value"), at.alias("observed_at")).where("value is not null and observed_at is not null")


def normalize_positions(df: DataFrame, product: str, json: str = "json") -> DataFrame:
    """{delaymarket: [...]} of futures contracts: index rows go, contracts are the product and four digits; one that occurs twice in
    an answer, a row of df, is an error."""
    row = "struct<contractname:string,instrumentid:string,volume:string,openinterest:string,openinterestchg:string,lastprice:string,updatetime:string>"
    x = df.select(F.monotonically_increasing_id().alias("_answer"), F.from_json(json, f"delaymarket array<{row}>").alias("j")).select("_answer", F.inline("j.delaymarket"))
    x = x.withColumn("contract", F.lower(F.coalesce("contractname", "instrumentid"))).where(F.col("contract").rlike(f"^{product}[0-9]{{4}}$"))
    whole = lambda c: F.try_to_number(F.regexp_replace(c, r"\.0+$", ""), F.lit("S999999999999")).cast("long")
    g = x.groupBy("_answer", "contract").agg(F.count("*").alias("_n"), F.first("volume").alias("v"), F.first("openinterest").alias("o"), F.first("openinterestchg").alias("c"), F.first("lastprice").alias("p"), F.first("updatetime").alias("updated"))
    once = F.when(F.col("_n") == 1, F.col("contract")).otherwise(F.raise_error(F.concat(F.lit("twice: "), "contract")))
    return g.select(F.lit(product).alias("product"), once.alias("contract"), whole("v").alias("volume"), whole("o").alias("open_interest"), whole("c").alias("oi_change"), F.col("p").cast("double").alias("last"), "updated")


def build_option_chain(master: DataFrame, quotes: DataFrame, delta: DataFrame, iv: DataFrame, pattern: str = r"^([a-z]+[0-9]{4})([CP])([0-9]+)$") -> DataFrame:
    """Contracts with their delayed quotes, last day's delta and the underlying's IV. The contract's id gives underlying, type and
    strike; more than max(5, 1 %) of the master without a quote is an error."""
    part = lambda i: F.regexp_extract("contract", pattern, i)
    m = master.where(F.col("contract").rlike(pattern)).select("contract", "expiry", "multiplier", part(1).alias("underlying"), F.when(part(2) == "C", "call").otherwise("put").alias("type"), part(3).cast("double").alias("strike"))
    lost = m.join(quotes, "contract", "left_anti").agg(F.count("*").alias("lost")).crossJoin(m.agg(F.count("*").alias("all")))  # one row each
    gate = lost.select(F.when(F.col("lost") > F.greatest(F.lit(5.0), F.col("all") * 0.01), F.raise_error(F.lit("too many contracts without quotes"))).otherwise(True).alias("ok"))
    j = m.join(quotes.select("contract", "last", "volume", "open_interest"), "contract").join(delta.select("contract", clamp_delta("delta").alias("delta")), "contract", "left").join(iv.select("underlying", "iv"), "underlying", "left")
    return j.crossJoin(F.broadcast(gate)).where("ok").drop("ok")  # one row


def explode_minute_lines(df: DataFrame, text: str, zone: str) -> DataFrame:
    """Rows of 'yyyyMMddHHmm,open,high,low,close,volume' joined by ';' -> bars in UTC: prices above zero, low <= open, close <=
    high, of one time the last; rows that don't parse are left out."""
    other = [c for c in df.columns if c not in (text, zone)]
    x = df.select(*other, zone, F.posexplode(F.split(text, ";")).alias("_n", "_line")).withColumn("_f", F.split("_line", ","))
    num = lambda i: F.try_to_number(F.get("_f", F.lit(i)), F.lit("999999999999.999999")).cast("double")
    at = F.try_to_timestamp(F.get("_f", F.lit(0)), F.lit("yyyyMMddHHmm"))
    bars = x.select(*other, "_n", F.to_utc_timestamp(at, F.col(zone)).alias("open_time"), *(num(i + 1).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))))
    good = bars.where("open_time is not null and open > 0 and high > 0 and low > 0 and close > 0 and low <= least(open, close) and high >= greatest(open, close)")
    return good.groupBy(*other, "open_time").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "_n").alias("b")).select(*other, "open_time", "b.*")


def last_tick_from_lines(df: DataFrame, text: str, trade_date: str, zone: str, night_from: int = 18) -> DataFrame:
    """Rows of 'HHmm,price' joined by ';' of one trade date -> the last with a price above zero; a time from night_from on is on the
    weekday before."""
    other = [c for c in df.columns if c != text]
    x = df.select(*other, F.posexplode(F.split(text, ";")).alias("_n", "_line")).withColumn("_f", F.split("_line", ","))
    x = x.withColumn("price", F.try_to_number(F.get("_f", F.lit(1)), F.lit("999999999999.999999")).cast("double")).withColumn("_t", F.get("_f", F.lit(0))).where("price > 0 and _t rlike '^[0-9]{4}$'")
    last = x.groupBy(*other).agg(F.max_by(F.struct("_t", "price"), "_n").alias("l"))
    d = F.col(trade_date)
    before = F.date_sub(d, F.when(F.weekday(d) == 0, 3).otherwise(1))
    hour = F.substring("l._t", 1, 2).cast("int")
    day = F.when(hour >= night_from, before).when((hour < 6) & (F.weekday(d) == 0), F.date_sub(d, 2)).otherwise(d)
    local = F.to_timestamp(F.concat_ws(" ", day.cast("string"), "l._t"), "yyyy-MM-dd HHmm")
    return last.select(*other, F.to_utc_timestamp(local, F.col(zone)).alias("observed_at"), F.col("l.price").alias("last"))


def daily_stats_from_lines(df: DataFrame, text: str, trade_date: str) -> DataFrame:
    """Rows of 'yyyyMMdd,open,high,low,close,volume' joined by ';' -> the last row of the trade date."""
    other = [c for c in df.columns if c != text]
    x = df.select(*other, F.posexplode(F.split(text, ";")).alias("_n", "_line")).withColumn("_f", F.split("_line", ",")).where(F.get("_f", F.lit(0)) == F.date_format(trade_date, "yyyyMMdd"))
    num = lambda i: F.try_to_number(F.get("_f", F.lit(i)), F.lit("999999999999.999999")).cast("double")
    return x.groupBy(*other).agg(F.max_by(F.struct(*(num(i + 1).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume")))), "_n").alias("s")).select(*other, "s.*")


def decode_bar_archives(spark: SparkSession, glob: str) -> DataFrame:
    """Gzip files of 48-byte records -> bars; a file whose length isn't a multiple of that, or with a price or range that can't be,
    is an error. A file is a day of one instrument, and read by one task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for path, content in zip(g["path"], g["content"], strict=True):
                data = gzip.decompress(content)
                if len(data) % ARCHIVE.itemsize:
                    raise ValueError(f"length of {path}")
                r = np.frombuffer(data, ARCHIVE)
                if len(r) and ((r["low"] <= 0).any() or (r["low"] > np.minimum(r["open"], r["close"])).any() or (r["high"] < np.maximum(r["open"], r["close"])).any()):
                    raise ValueError(f"prices of {path}")
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "open_time": pd.to_datetime(r["t"], unit="s"), **{c: r[c] / 1e6 for c in ("open", "high", "low", "close")}, "volume": r["volume"], "record": np.arange(len(r))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(glob).select("path", "content")
    return files.mapInPandas(decode, "file string, open_time timestamp, open double, high double, low double, close double, volume long, record long")


def write_bar_archives(bars: DataFrame, root: str, file: str = "file") -> DataFrame:
    """bars(file, open_time, OHLC, volume) as gzip archives under root, a folder all executors share: one for each file name, in the
    order of time. Returns file and records of each. A task that runs again writes the same bytes over the same name."""

    def write(g: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        g = g.sort_values("open_time")
        rows = np.zeros(len(g), ARCHIVE)
        rows["t"] = g["open_time"].astype("int64") // 1_000_000_000 if g["open_time"].dtype == "datetime64[ns]" else g["open_time"].astype("datetime64[s]").astype("int64")
        for c in ("open", "high", "low", "close"):
            rows[c] = np.rint(g[c].to_numpy() * 1e6)
        rows["volume"] = g["volume"]
        store, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        store.create_dir(base, recursive=True)
        name = g[file].iloc[0]
        with store.open_output_stream(f"{base}/.{name}.tmp", compression=None) as out:
            out.write(gzip.compress(rows.tobytes(), mtime=0))
        store.move(f"{base}/.{name}.tmp", f"{base}/{name}")
        return pd.DataFrame({"file": [name], "records": [len(g)]})

    return bars.groupBy(file).applyInPandas(write, "file string, records long")


def archive_completeness(manifest: DataFrame, bars: DataFrame) -> DataFrame:
    """manifest(file, range_start, range_end, declared) with found, the records of the file inside the range, and complete. Records are
    counted per file and range before anything is joined back."""
    ranges = manifest.select("file", "range_start", "range_end").distinct()
    inside = bars.select("file", "open_time").join(ranges, "file").where((F.col("open_time") >= F.col("range_start")) & (F.col("open_time") <= F.col("range_end")))
    found = inside.groupBy("file", "range_start", "range_end").agg(F.count("*").alias("found"))
    return manifest.join(found, ["file", "range_start", "range_end"], "left").na.fill(0, ["found"]).withColumn("complete", F.col("found") == F.col("declared"))


def read_frame_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw provider frames (version, channel, connection, sequence, received_at, encoding, body) with their message id, each once;
    frames of an unknown version or encoding are left out."""
    schema = "version int, channel string, connection string, sequence long, received_at timestamp, encoding string, body binary"
    return frame_log(spark.readStream.schema(schema).parquet(path) if stream else spark.read.schema(schema).parquet(path), stream)


def frame_log(raw: DataFrame, stream: bool = False) -> DataFrame:
    """Rows of a frame log as read_frame_log gives them; on a stream a frame counts once within ten minutes of receipt."""
    ok = raw.where("version = 1 and encoding in ('wide', 'narrow') and sequence >= 0 and channel <> '' and connection <> ''")
    framed = ok.withColumn("msg_id", message_id())
    return framed.withWatermark("received_at", "10 minutes").dropDuplicatesWithinWatermark(["msg_id"]) if stream else framed.dropDuplicates(["msg_id"])


def message_id() -> Column:
    return F.concat_ws(":", "channel", "connection", F.col("sequence").cast("string"))


def encode_frames(ticks: DataFrame) -> DataFrame:
    """ticks(channel, connection, sequence, received_at, encoding, instrument, observed_at, last) as raw frames."""
    little = lambda x, n: F.reverse(F.substring(F.lpad(F.hex(x), 16, "0"), 17 - 2 * n, 2 * n))
    # hex digits reversed are bytes reversed with their digits swapped: swap them back
    swapped = lambda x, n: F.regexp_replace(little(x, n), "(.)(.)", "$2$1")
    price = F.round(F.col("last") * 1_000_000).cast("long")
    wide = F.col("encoding") == "wide"
    head = F.concat(F.lpad(F.hex(F.length("instrument").cast("long")), 2, "0"), F.hex("instrument"))
    body = F.unhex(F.concat(head, F.when(wide, swapped(F.expr("unix_micros(observed_at) div 1000"), 8)).otherwise(swapped(F.unix_seconds("observed_at"), 4)), swapped(price, 8)))
    return ticks.select(F.lit(1).alias("version"), "channel", "connection", F.col("sequence").cast("long").alias("sequence"), "received_at", "encoding", body.alias("body"))


def decode_frames(frames: DataFrame) -> DataFrame:
    """Frames -> ticks: a byte of length, the symbol, then millisecond time and price in millionths as little-endian integers, eight
    bytes each (wide), or four of seconds and eight of price (narrow). A frame that doesn't decode is a row with its error."""
    body, n = F.col("body"), F.conv(F.hex(F.substring("body", 1, 1)), 16, 10).cast("int")
    wide = F.col("encoding") == "wide"
    width = F.when(wide, 8).otherwise(4)
    # little-endian bytes as a number: hex digits turned round pair by pair
    number = lambda at, size: F.conv(F.regexp_replace(F.reverse(F.hex(F.substr(body, at, size))), "(.)(.)", "$2$1"), 16, -10).cast("long")
    symbol = F.substr(body, F.lit(2), n)
    error = F.when(F.length(body) < 1, "IndexError").when(F.length(body) != 1 + n + width + 8, "ValueError").when(~F.hex(symbol).rlike("^([0-7][0-9A-F])*$"), "UnicodeDecodeError")
    x = frames.withColumn("error", error)
    ok = F.col("error").isNull()
    time = number(n + 2, width)
    at = F.when(wide, F.timestamp_millis(time)).otherwise(F.timestamp_seconds(time))
    return x.select(
        "msg_id", F.when(ok, F.decode(symbol, "US-ASCII")).alias("instrument"), F.when(ok, at).alias("observed_at"), F.when(ok, number(n + 2 + width, F.lit(8)) / 1e6).alias("last"), "error", "channel", "sequence", "received_at")
