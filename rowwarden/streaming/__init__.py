"""Validation of streams: stateless columns, written as good and quarantined rows per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import annotate
from ..schema import Schema


def split_stream(df: DataFrame, schema: Schema, good: str, quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends good rows and quarantined rows with their issues to two Parquet folders.

    Both writes of a micro-batch use its id as a partition, overwritten if the batch is run again, so a restart
    neither loses nor repeats rows.
    """

    def write(rows: DataFrame, batch: int) -> None:
        marked = rows.persist()
        clean = F.size("_issues") == 0
        marked.where(clean).drop("_issues", "_issues_truncated").write.mode("overwrite").parquet(f"{good}/batch={batch}")
        marked.where(~clean).write.mode("overwrite").parquet(f"{quarantine}/batch={batch}")
        marked.unpersist()

    return annotate(df, schema).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
