"""Helpers that the text-corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule (space, tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_dir: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own_dir[0]
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_by_hash(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The ``n`` distinct keys of least hash. A cut at twice the wanted share of the distinct keys goes first, so that tasks
    pass on about 2n keys in all, however often a key is repeated."""
    known = rows.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    share = min(1.0, (2 * n + 100) / max(1, known))
    order = F.shiftrightunsigned(F.xxhash64(key), 1)
    return rows.where(order <= min(2**63 - 1, int(share * 2**63))).select(key).distinct().orderBy(order, key).limit(n)


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per value of ``keys`` (nulls are equal) with the ``text`` of least hash, in whatever order the tasks come."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def one_blas_thread() -> None:
    """Limit numpy's matrix products to one thread: Spark already runs a task on each core, and waiting threads cost its time."""
    for lib in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        held = ctypes.CDLL(str(lib))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(held, name):
                getattr(held, name)(1)
                break


def keep_freed_memory() -> None:
    """Let glibc hold up to 32 MB of freed memory: numpy's work arrays of each step else go back to the system and are mapped and
    zeroed anew, a fifth of the training time of a fresh worker (measured in one thread)."""
    held = ctypes.CDLL(None)
    if hasattr(held, "mallopt"):
        held.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        held.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """The runs of characters that are no white space; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_RUN), "")


def bucket(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def unused(columns: list[str], base: str) -> str:
    """A column name that none of ``columns`` has, in any case of letters."""
    taken, name = {c.lower() for c in columns}, f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name
