"""Readers of market archives: klines, ticks, derivative metrics, daily indices, candidate records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bars import seconds_of

#: Columns of a kline row, in file order. Fixed values.
KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
#: Columns of a tick row, in file order; further ones are named extra_0, extra_1, ... Fixed values.
TICK = ("id", "timestamp", "price", "volume", "side", "rpi")
#: Header of a derivative metrics file. Fixed values.
METRICS = (
    "create_time", "symbol", "sum_open_interest", "sum_open_interest_value", "count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio",
    "count_long_short_ratio", "sum_taker_long_short_vol_ratio",
)


class HeaderMismatch(ValueError):
    """A metrics file whose header isn't the known one."""


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Zip archives of kline CSV files, with or without a header line, as normalised rows (see ``normalise_klines``); lines of another width go."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {
            "read_options": pacsv.ReadOptions(column_names=list(KLINE), block_size=4 << 20),
            "parse_options": pacsv.ParseOptions(invalid_row_handler=lambda row: "skip"),
            "convert_options": pacsv.ConvertOptions(column_types={c: pa.string() for c in KLINE}, strings_can_be_null=True, null_values=[""]),
        }
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        # Parsed block by block from the compressed stream.
                        with z.open(name) as f:
                            yield from pacsv.open_csv(f, **options)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, ", ".join(f"{c} string" for c in KLINE))
    return normalise_klines(raw)


def normalise_klines(raw: DataFrame) -> DataFrame:
    """Numbers and seconds from text; a header line and rows without prices go. Missing trade counts are 0."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    out = raw.select(
        F.floor(seconds_of(F.col("open_time").try_cast("double"))).alias("t"),
        *[number(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base")],
        F.coalesce(F.col("trades").try_cast("double"), F.lit(0.0)).cast("long").alias("trades"),
        F.floor(seconds_of(F.col("close_time").try_cast("double"))).alias("close_t"),
    )
    return out.dropna(subset=["t", "open", "high", "low", "close"])


def closed_only(klines: DataFrame, now: int) -> DataFrame:
    """Bars that were over at ``now`` (seconds)."""
    return klines.where(F.col("close_t") < now)


def read_ticks(spark: SparkSession, path: str, extras: int = 0) -> DataFrame:
    """Plain or gzip tick files: columns are known by place, a header line is dropped because its price is no number."""
    names = [*TICK[:5], *([TICK[5]] if extras else []), *[f"extra_{i}" for i in range(max(0, extras - 1))]]
    raw = spark.read.csv(path, header=False, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), mode="PERMISSIVE")
    price, volume = F.col("price").try_cast("double"), F.col("volume").try_cast("double")
    return raw.select(F.col("id"), (seconds_of(F.col("timestamp").try_cast("double")) * 1e6).cast("long").alias("us"), price.alias("price"), volume.alias("volume"), F.lower("side").alias("side")).where("price is not null and volume is not null")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Derivative metrics; a file with another header, or without one, stops the read with HeaderMismatch.

    One pass over the lines checks all headers, counted file by file; one reads the rows.
    """
    header, line = ",".join(METRICS), F.trim("value")
    like = line.startswith(METRICS[0])
    lines = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.when(line == header, 1)).alias("good"), F.count(F.when(like, 1)).alias("headers"))
    if lines.where("good <> 1 OR headers <> 1").limit(1).collect():
        raise HeaderMismatch(f"{path}: expected {header}")
    schema = T.StructType([T.StructField(n, T.StringType() if n in METRICS[:2] else T.DoubleType()) for n in METRICS])
    rows = spark.read.csv(path, header=True, schema=schema)
    # Zeros stand for missing values.
    return rows.select(F.unix_timestamp("create_time").alias("t"), "symbol", *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in METRICS[2:]])


def read_daily_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents {"data": [{"value": "..", "timestamp": "..", ...}]} as (day, value, meta), by day."""
    item = "array<struct<value: string, timestamp: string, value_classification: string>>"
    rows = spark.read.schema(f"data {item}").json(path, multiLine=True).select(F.explode("data").alias("d"))
    return rows.select(
        F.floor(F.col("d.timestamp").cast("long") / 86400).alias("day"), F.col("d.value").cast("double").alias("value"), F.to_json(F.struct("d.value_classification")).alias("meta")
    ).orderBy("day")


def read_candidates(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, bare or wrapped in {"payload": ...}; broken lines are dropped."""
    text = spark.read.text(path)
    inner = F.coalesce(F.get_json_object("value", "$.payload"), F.col("value"))
    parsed = F.from_json(inner, schema, {"mode": "PERMISSIVE"})
    return text.where(F.get_json_object("value", "$").isNotNull()).select(parsed.alias("c")).select("c.*").dropna("all")


def parse_record(text: str) -> dict[str, str]:
    """Fields of a text record: lines of key: value or key = value; "#" lines and what follows an arrow are comments."""
    import re

    out = {}
    for line in text.splitlines():
        line = line.split("←")[0].strip()
        if m := re.match(r"([A-Za-z_]\w*)\s*[:=]\s*(.*)$", line):
            out[m[1]] = m[2].strip().strip("\"'")
    return out


def parse_records(texts: DataFrame, column: str, fields: T.StructType) -> DataFrame:
    """Text or JSON records as typed columns, in Spark expressions; what doesn't parse is null."""
    lines = F.filter(F.split(F.col(column), "\n"), lambda x: ~F.ltrim(x).startswith("#"))
    pairs = F.transform(lines, lambda x: F.trim(F.split_part(x, F.lit("←"), F.lit(1))))
    as_map = F.map_from_entries(
        F.filter(
            F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_]\w*)\s*[:=]", 1).alias("key"), F.trim(F.regexp_replace(x, r"^[A-Za-z_]\w*\s*[:=]\s*", "")).alias("value"))),
            lambda e: e["key"] != "",
        )
    )
    parsed = texts.withColumn("_m", F.when(F.ltrim(column).startswith("{"), F.from_json(column, "map<string,string>")).otherwise(as_map))
    return parsed.select(*[F.element_at("_m", f.name).try_cast(f.dataType).alias(f.name) for f in fields.fields])


#: Venue -> reader of its archives.
VENUES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"klines": read_klines, "ticks": read_ticks, "metrics": read_metrics}


def read_many(spark: SparkSession, wanted: dict[str, tuple[str, str]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """symbol -> (venue, path): a frame for each symbol that can be read, and the error of each that can't."""
    found, failed = {}, {}
    for symbol, (venue, path) in wanted.items():
        try:
            found[symbol] = VENUES[venue](spark, path).withColumn("symbol", F.lit(symbol))
        except Exception as e:  # one symbol's failure is that symbol's
            failed[symbol] = f"{type(e).__name__}: {e}"
    return found, failed
