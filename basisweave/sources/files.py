"""Landed files: envelope Parquet, JSONL by signal and day, candle trees, sharded session logs, JDBC."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKER_SCHEMA = "type string, ts timestamp, snapshot_idx int, exchange string, coin string, bid double, ask double, mid double, error string"
ENVELOPE = ["window_id", "ts", "snapshot_idx", "exchange", "coin", "error", "payload"]

_own: list[str] = []


def landing(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: one evaluation, and no lineage to lose."""
    path = landing(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_envelope(rows: DataFrame, path: str, payload: list[str]) -> None:
    """Hoist the key columns, the rest as compact JSON; partitioned by window for pruning."""
    hoisted = rows.withColumn("payload", F.to_json(F.struct(*payload)))
    for c in ENVELOPE:
        if c not in hoisted.columns:
            hoisted = hoisted.withColumn(c, F.lit(None).cast("string"))
    hoisted.select(*ENVELOPE).write.partitionBy("window_id").parquet(path)


def read_envelope(spark: SparkSession, path: str, payload_schema: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Error-free rows of a half-open snapshot range with the payload parsed; the cut reaches the Parquet scan."""
    rows = spark.read.parquet(path).where("error is null")
    if start is not None:
        rows = rows.where(F.col("snapshot_idx") >= start)
    if stop is not None:
        rows = rows.where(F.col("snapshot_idx") < stop)
    return rows.withColumn("p", F.from_json("payload", payload_schema)).select(*(c for c in ENVELOPE if c not in ("payload", "error")), "p.*")


def write_signals(rows: DataFrame, path: str, max_lines: int | None = None) -> None:
    """JSON lines by record type and day, optionally rotated at ``max_lines`` a file."""
    w = rows.withColumn("day", F.date_format("ts", "yyyyMMdd")).withColumn("signal", F.col("type")).write.partitionBy("signal", "day")
    (w.option("maxRecordsPerFile", max_lines) if max_lines else w).json(path)


def read_signals(spark: SparkSession, path: str, schema: str, signal: str) -> DataFrame:
    """One signal of either layout: a folder a signal, or flat files tagged by ``type``. Malformed, blank and error rows go."""
    bad = f"{schema}, _corrupt_record string"
    rows = spark.read.schema(bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").json(path)
    return rows.where((F.col("type") == signal) & F.col("_corrupt_record").isNull() & F.col("error").isNull()).drop("_corrupt_record", "error")


def read_marked_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that may begin with a byte-order mark; lines that don't parse go."""
    line = F.regexp_replace("value", "^\ufeff", "")
    parsed = F.from_json(line, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path).select(parsed.alias("r")).select("r.*").where("_corrupt_record is null").drop("_corrupt_record")


def pool_runs(spark: SparkSession, base: str, roles: dict[str, str], name: str) -> DataFrame:
    """One table of several runs below ``base``, tagged by run and role; columns that a run lacks are null."""
    out = None
    for run, role in roles.items():
        rows = spark.read.parquet(f"{base}/{run}/{name}").withColumns({"window_id": F.lit(run), "role": F.lit(role)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``, refused where one of the columns is missing."""
    if missing := sorted(set(columns) - set(rows.columns)):
        raise ValueError(f"the source lacks {missing}")
    return rows


def write_candle_tree(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("coin", "exchange").parquet(path)


def read_candle_tree(spark: SparkSession, path: str) -> DataFrame:
    """Candles with asset and venue from the path."""
    raw = spark.read.option("recursiveFileLookup", "true").parquet(path)
    where = F.input_file_name()
    return raw.withColumn("coin", F.regexp_extract(where, "coin=([^/]+)/", 1)).withColumn("exchange", F.regexp_extract(where, "exchange=([^/]+)/", 1))


def write_jdbc(rows: DataFrame, url: str, name: str, batch: int = 10_000, **options: str) -> None:
    """Batched load of the envelope into a database table."""
    rows.write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", batch).options(**options).mode("append").save()


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns, arrays as '[n items]'."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
        elif kind == "array":
            cols.append(F.concat(F.lit("["), F.size(f.name).cast("string"), F.lit(" items]")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
