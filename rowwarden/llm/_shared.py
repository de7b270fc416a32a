"""Session helpers: tables that outlive a lost executor, joins with a side of checked size, batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows up to which a side of narrow rows (a few longs) may be broadcast.
BROADCAST_ROWS = 2_000_000

#: Bytes of a batch that goes to a Python worker: as much as one numpy pass covers (``_text.SLAB_BYTES``).
BATCH_BYTES = 2 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local master, where the driver is the executor, may run without that setting.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="rowwarden-")
    return _local_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage beyond those files, so a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowwarden/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def if_few(df: DataFrame, lists: str, limit: int = 8_000_000) -> DataFrame:
    """As :func:`if_small` for rows with a column of integer arrays, by their size in 8-byte words."""
    rows, elements = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(df) if 6 * rows + elements // 2 <= limit else df


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Batches for Python take ``most`` bytes in this session, or one row; a session that sets that limit keeps its own.

    By default only 10000 rows end a batch of texts: JVM and Python worker hold some of these at once, and both keep
    the memory. The limit is of the session, so it holds when the caller runs what a stage returned.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, most)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def require_integral(df: DataFrame, *names: str) -> None:
    """Refuses a table whose ids aren't whole numbers, before any job."""
    for name in names:
        kind = df.select(name).schema[0].dataType
        if not isinstance(kind, IntegralType):
            raise TypeError(f"{name} must be a whole number, not {kind.simpleString()}")
