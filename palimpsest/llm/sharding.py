"""Sharding by sampled splitters.

The law is `bytes`: shards get near equal sizes. Rows are ordered by (text_crc32, doc_id), so copies of a
text lie side by side. Splitters come from a size-weighted sample of the keys; they cut the key space into many
small ranges. Ranges that turn out overfull (one key may hold a third of all rows) are subdivided by a hash of
doc_id, and rows that repeat with doc_id and text by their place in the table. The exact bytes of the ranges then place every range on one line of bytes, and a row's shard follows
from the middle of its bytes on that line, so a shard deviates from the mean by one row at most.

Keys and sizes are computed once, into a table; everything after reads that. Splitters and offsets are tables too: what is ordered as a whole is one row for each of 65,536 slots of the key, or for each
CHUNK ranges; nothing of it comes to the driver. Ranges grow with the bytes, so a task sorts about RANGE_BYTES.

Nulls: a null text has size 8 and the CRC of the empty text, a null doc_id sorts first. Repeated rows keep their
places one after the other. An empty table gives an empty result. Columns beside doc_id and text pass through `assign_shards`; those named _size, _key, shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hinted

#: Keys drawn per range, ranges per shard at least, bytes per range at most on average, and by how much a range may exceed the mean.
SAMPLE_PER_RANGE, RANGES_PER_SHARD, RANGE_BYTES, OVERFULL = 16, 64, 256 << 20, 2.0
#: Slots of the 32-bit key, and ranges that are summed up in one piece.
SLOTS, CHUNK = 1 << 16, 1024
MADE = ("_size", "_key", "shard", "slot")


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + F.lit(8).cast("long")


def _slot(key: Column) -> Column:
    return F.shiftright(key, 16).cast("int")


def draw_splitters(keyed: DataFrame, total: int, ranges: int) -> DataFrame:
    """_key: up to ranges - 1 different keys that cut the bytes near equally, from about SAMPLE_PER_RANGE * ranges sampled keys."""
    wanted = SAMPLE_PER_RANGE * ranges
    share = F.least(F.lit(1.0), F.col("_size") * F.lit(wanted / max(total, 1)))
    dice = F.pmod(F.xxhash64("_key", "_tie", F.lit("splitters")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A row larger than total / wanted is drawn surely and stands for its own bytes, others for total / wanted.
    drawn = keyed.where(dice < share).groupBy("_key").agg(F.sum(F.greatest(F.col("_size").cast("double"), F.lit(total / wanted))).alias("weight"))
    drawn = cut(drawn.withColumn("_slot", _slot(F.col("_key"))))
    slots = drawn.groupBy("_slot").agg(F.sum("weight").alias("own"))  # SLOTS rows at most
    every = Window.orderBy("_slot")
    slots = slots.select("_slot", (F.sum("own").over(every) - F.col("own")).alias("before"), F.sum("own").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    within = Window.partitionBy("_slot").orderBy("_key")
    seen = F.col("before") + F.sum("weight").over(within) - F.col("weight")
    placed = drawn.join(F.broadcast(slots), "_slot").select("_key", F.floor(seen * F.lit(ranges) / F.col("all")).alias("step"))
    return placed.where("step >= 1").groupBy("step").agg(F.min("_key").alias("_key")).select("_key").distinct()


def with_range(keyed: DataFrame, splitters: DataFrame, ranges: int) -> DataFrame:
    """keyed with _range: how many splitters are not above _key. A table of slots has for each the splitters below it, as a number, and those within."""
    own = splitters.groupBy(_slot(F.col("_key")).alias("_slot")).agg(F.array_sort(F.collect_list("_key")).alias("inner"))
    slots = keyed.sparkSession.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("_slot")).join(own, "_slot", "left")
    inner = F.coalesce("inner", F.expr("cast(array() as array<bigint>)"))
    n = F.size(inner)
    slots = slots.select("_slot", (F.sum(n).over(Window.orderBy("_slot")) - n).cast("int").alias("base"), inner.alias("inner"))
    found = keyed.withColumn("_slot", _slot(F.col("_key"))).join(hinted(slots, SLOTS + ranges), "_slot")
    return found.withColumn("_range", F.col("base") + F.size(F.filter("inner", lambda s: s <= F.col("_key")))).drop("_slot", "base", "inner")


def _offsets(sizes: DataFrame) -> DataFrame:
    """_range, _part with the bytes and rows of all before; sizes: _range, _part, size, n."""
    chunked = sizes.withColumn("chunk", F.floor(F.col("_range") / CHUNK))
    chunks = chunked.groupBy("chunk").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    every, own = Window.orderBy("chunk"), Window.partitionBy("chunk").orderBy("_range", "_part")
    chunks = chunks.select("chunk", (F.sum("size").over(every) - F.col("size")).alias("_bytes"), (F.sum("n").over(every) - F.col("n")).alias("_rows"))
    inner = chunked.select("chunk", "_range", "_part", (F.sum("size").over(own) - F.col("size")).alias("size"), (F.sum("n").over(own) - F.col("n")).alias("n"))
    return inner.join(F.broadcast(chunks), "chunk").select("_range", "_part", (F.col("size") + F.col("_bytes")).alias("_bytes"), (F.col("n") + F.col("_rows")).alias("_rows"))


def assign_shards(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """docs with _size, _key, shard and slot (gapless from 0 within a shard). The text itself is moved along only if keep_text."""
    rest = [c for c in docs.columns if c.lower() not in MADE and (keep_text or c != text)]
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    keyed = cut(docs.select(F.struct(*rest).alias("_doc"), row_size(F.col(text)).alias("_size"), crc.alias("_key"), F.col(key).alias("_tie"), F.monotonically_increasing_id().alias("_id")))
    total = int(keyed.agg(F.sum("_size")).first()[0] or 0)
    ranges = max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    mean = max(1.0, total / ranges)
    ranged = with_range(keyed, cut(draw_splitters(keyed, total, ranges)), ranges)

    over = ranged.groupBy("_range").agg(F.sum("_size").alias("size")).where(F.col("size") > OVERFULL * mean)
    over = cut(over.select("_range", F.ceil(F.col("size") / mean).alias("_parts")))  # fewer rows than ranges / OVERFULL
    split = ranged.join(hinted(over, ranges), "_range", "left")
    same = ["_range", "_key", "_tie"]
    copies = cut(split.where("_parts is not null").groupBy(*same).agg(F.sum("_size").alias("size")).where(F.col("size") > mean).select(*same, F.lit(True).alias("_many")))  # fewer rows than ranges
    split = split.join(hinted(copies.withColumnRenamed("_tie", "_tied").withColumnsRenamed({"_range": "_r", "_key": "_k"}), ranges), F.expr("_range = _r and _key = _k and _tie <=> _tied"), "left").drop("_r", "_k", "_tied")
    salt = F.when(F.col("_many"), F.col("_id")).otherwise(F.lit(-1))
    split = split.withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_tie", salt, F.lit("parts")), F.col("_parts"))).cast("int")).drop("_parts", "_many")

    offsets = cut(_offsets(split.groupBy("_range", "_part").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))))  # three times as many rows as ranges at most
    w = Window.partitionBy("_range", "_part").orderBy("_key", "_tie", "_size", "_id")
    before = F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    middle = F.col("_bytes") + F.col("_before") + (F.col("_size") / 2).cast("long")
    placed = (
        split.join(hinted(offsets, 3 * ranges), ["_range", "_part"])
        .withColumns({"_before": before, "_nth": F.row_number().over(w).cast("long") - 1 + F.col("_rows")})
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(total, 1)))).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("_nth").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("_doc.*", "_size", "_key", "shard", (F.col("_nth") - F.col("_first")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = assign_shards(docs)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_key").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
