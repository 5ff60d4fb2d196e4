"""What the operators of this subpackage share: written tables, input columns, the query registry."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its check in SQL if there is one."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session whose executors live in the driver's own process may do without that setting;
    it gets a temporary folder, one for all callers.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="resurvey-llm-"))
        return _OWN_FOLDER[0]
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other caller gets."""
    unique = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{shared_folder(spark)}/{name}-{unique}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    It cuts the lineage: what follows survives lost executors without running ``df`` again, and
    several consumers read the same rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes of a table that may be broadcast, as its rows lie in memory.
BROADCAST_BYTES = 64 << 20


def _row_bytes(name: str, kind) -> F.Column:
    """About the bytes that a value takes in memory."""
    col = F.col(f"`{name}`")
    if kind.typeName() in ("string", "binary"):
        return F.lit(24) + F.coalesce(F.octet_length(col), F.lit(0))
    if kind.typeName() in ("array", "map"):
        return F.lit(24) + 64 * F.greatest(F.size(col), F.lit(0))
    return F.lit(16)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table of numbers, strings and lists of numbers, marked for broadcast if it takes at most ``limit`` bytes.

    Beyond that Spark joins it by shuffling.
    """
    width = sum((_row_bytes(f.name, f.dataType) for f in df.schema), F.lit(0).cast("long"))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, leaving out any others the input may have."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def release_memory() -> None:
    """Give back to the system what a Python worker has freed; Spark keeps workers for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it decides by itself
        pass


def lean(run):
    """``run`` over batches, giving memory back at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def mixed(*cols) -> F.Column:
    """A 64-bit hash of the columns."""
    return F.xxhash64(*cols)


def hash_sample(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """At most ``rows`` rows of a written table, those with the smallest hashes of ``cols``.

    Where there are many more, a border on the hash lets through few of them, so that what is
    sorted has the size of the sample and not that of the table or of its number of parts.
    """
    hashed = df.withColumn("_hash", mixed(*cols))
    n = df.count()
    if n > rows:
        share = min(1.0, (rows + 8 * rows**0.5 + 8) / n)
        hashed = hashed.where(F.col("_hash") <= min((1 << 63) - 1, int(share * 2**64) - (1 << 63)))
    return hashed.orderBy("_hash", *cols).limit(rows).drop("_hash")


def parts_for(n: int, per_part: int, least: int = 1) -> int:
    """How many parts hold ``n`` units at ``per_part`` each."""
    return max(least, -(-n // per_part))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of all pieces, one piece behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type = np.int64):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.zeros(max(self.n, len(more)) + len(more), self.data.dtype)))
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)
