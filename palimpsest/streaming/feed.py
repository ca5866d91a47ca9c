"""Streams in and out: micro-batches become transactions, and transactions a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import TableConfig
from ..plans.store import Batch, Engine


def apply_stream(engine: Engine, table: str, stream: DataFrame, to_rows: Callable[[DataFrame, TableConfig], DataFrame], checkpoint: str, name: str, **trigger):
    """Starts a query that applies each micro-batch as one transaction.

    The load id is the query's name and the batch's number: a batch that is replayed after a failure finds its own receipt, so each is applied exactly once. Late rows follow the table's policy; no watermark drops any.
    """

    def one(df: DataFrame, batch: int) -> None:
        load_id = f"{name}-{batch}"
        if engine.manifest(load_id) is None and not df.isEmpty():
            engine.apply(load_id, [Batch(table, to_rows(df, engine.config(table)))], {"stream": name, "batch": batch})

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()


def change_feed(engine: Engine, table: str, after_txn: int = 0) -> DataFrame:
    """Versions that were written after a transaction, in no order."""
    return engine.log(table).where(F.col("_txn_id") > after_txn)


def change_stream(spark: SparkSession, engine: Engine, table: str) -> DataFrame:
    """The same as a stream over the version files, each version once. A compacted folder repeats older transactions' rows, and is passed over."""
    schema = engine._read([], engine.config(table)).schema
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(engine.files.at("tables", table, "versions", "txn=*"))
    own = F.regexp_extract(F.col("_metadata.file_path"), r"/txn=([0-9]+)/", 1).cast("bigint") == F.col("_txn_id")
    return raw.where(own).drop("_bucket")
