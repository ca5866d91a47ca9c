"""Queries over the test tables: each operator on data with natural late arrivals, repeated instants and unchanged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import coerce, parse_timestamp
from ..operators import reads
from ..operators.decide import Decision, decide, fold, missing_keys, touched
from ..operators.intervals import from_intervals
from ..operators.publish import consolidate, render
from ..operators.stage import from_frame, stage
from .config import Gate, TableConfig
from .files import settled
from .types import parse_type

ORDERS = TableConfig(
    "order_status", ("o_custkey",), (("o_custkey", "long"), ("o_orderstatus", "string"), ("o_orderpriority", "string"), ("o_orderdate", "timestamp")),
    ignored_columns=("o_orderdate",), valid_time_mode="source_column", valid_time_column="o_orderdate",
)
EVENTS = TableConfig("user_state", ("user_id",), (("user_id", "long"), ("event_type", "string"), ("value", "double"), ("ts", "timestamp")), ignored_columns=("ts",), valid_time_mode="source_column", valid_time_column="ts")
#: A valid time inside the test data.
AS_OF = "1996-06-30 00:00:00"


def _with(cfg: TableConfig, **changes) -> TableConfig:
    from dataclasses import replace

    return replace(cfg, **changes)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pending(rows: DataFrame, cfg: TableConfig, tx: str = "2030-01-01") -> DataFrame:
    return stage(rows, cfg, F.lit(tx).cast("timestamp")).where("_reason is null")


def _none(cfg: TableConfig, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], cfg.schema.add("_valid_from", "timestamp").add("_valid_to", "timestamp").add("_op", "string"))


def _orders(spark: SparkSession, sf_dir: str, cfg: TableConfig = ORDERS, batch: int = 0, of: int = 1) -> DataFrame:
    """orders as changes of a customer's status; of rows at one instant the largest order key wins. They arrive in `of` batches of neighbouring order keys, whose dates overlap."""
    df = _table(spark, sf_dir, "orders")
    if of > 1:
        keys = (df.agg(F.max("o_orderkey")).first()[0] or 0) + 1
        df = df.where(F.floor(F.col("o_orderkey") * of / keys) == batch)
    return _pending(from_frame(df, cfg, F.col("o_orderkey")), cfg)


def _events(spark: SparkSession, sf_dir: str, cfg: TableConfig = EVENTS, absent: Column | None = None) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    return _pending(from_frame(df, cfg, F.col("event_id"), F.col("event_type") == "error", absent=absent), cfg)


def _plain(df: DataFrame) -> DataFrame:
    """Instants as timestamps without zone, as the tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _chain(df: DataFrame, cfg: TableConfig, *more: str) -> DataFrame:
    names = [c for c in cfg.names if c != cfg.valid_time_column]
    return _plain(df.select(*names, F.col("_valid_from").alias("valid_from"), F.col("_valid_to").alias("valid_to"), F.col("_op").alias("op"), *more))


def _first(spark: SparkSession, sf_dir: str, cfg: TableConfig = ORDERS) -> DataFrame:
    return fold(None, _orders(spark, sf_dir, cfg), cfg, 1)


def _beliefs(spark: SparkSession, sf_dir: str, cfg: TableConfig = ORDERS, of: int = 3) -> DataFrame:
    """The log after all batches. Each batch reads the log twice, so what it is by then is settled first."""
    log = None
    for n in range(of):
        log = fold(None if log is None else settled(log), _orders(spark, sf_dir, cfg, n, of), cfg, n + 1)
    return log


def scd2_chain_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(_first(spark, sf_dir), ORDERS)


def scd2_current_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(reads.current(_first(spark, sf_dir), ORDERS), ORDERS)


def scd2_asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(reads.as_of(_first(spark, sf_dir), ORDERS, AS_OF), ORDERS)


def scd2_history_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = reads.history(_beliefs(spark, sf_dir), ORDERS)
    return _chain(h.withColumnsRenamed({"_tx": "tx", "_is_current": "is_current"}), ORDERS, "tx", "is_current")


def bitemporal_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = settled(_beliefs(spark, sf_dir))
    out = [_chain(reads.as_of(log, ORDERS, AS_OF, tx), ORDERS).withColumn("known_at", F.lit(tx)) for tx in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def latest_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(reads.latest(_beliefs(spark, sf_dir), ORDERS).withColumnRenamed("_tx", "tx"), ORDERS, "tx")


def _second(spark: SparkSession, sf_dir: str, cfg: TableConfig) -> Decision:
    log = settled(fold(None, _orders(spark, sf_dir, cfg, 0, 2), cfg, 1))
    pending = _orders(spark, sf_dir, cfg, 1, 2)
    return decide(touched(reads.latest(log, cfg), pending, cfg), pending, cfg)


def _counts(d: Decision) -> DataFrame:
    made = d.changes.where("_outcome is not null").select(F.col("_outcome").alias("what"), F.col("_late").alias("late"))
    return made.unionByName(d.refused.select(F.col("_fate").alias("what"), F.lit(False).alias("late"))).groupBy("what").agg(F.count("*").alias("n"), F.sum(F.col("late").cast("long")).alias("late_splits"))


def late_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(_second(spark, sf_dir, ORDERS))


def late_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(_second(spark, sf_dir, _with(ORDERS, late_policy="reject")))


def late_quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _second(spark, sf_dir, _with(ORDERS, late_policy="quarantine"))
    return _plain(d.refused.where("_fate = 'late_quarantine'").select("o_custkey", F.col("_valid_from").alias("valid_from"), "o_orderstatus", "o_orderpriority"))


def dup_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = _with(ORDERS, same_batch_duplicates="reject")
    d = decide(_none(cfg, spark), _orders(spark, sf_dir, cfg), cfg)
    return _plain(d.refused.select("_fate", "o_custkey", F.col("_valid_from").alias("valid_from"), F.col("_ord").alias("o_orderkey")).withColumnRenamed("_fate", "fate"))


def soft_delete_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(fold(None, _events(spark, sf_dir), EVENTS, 1), EVENTS)


def delete_ignore_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = _with(EVENTS, deletes="ignore")
    return _chain(fold(None, _events(spark, sf_dir, cfg), cfg, 1), cfg)


def reinsert_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fold(None, _events(spark, sf_dir), EVENTS, 1)
    return log.groupBy(F.col("_op").alias("op")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def carry_forward_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = _with(EVENTS, absent_columns="carry_forward")
    absent = F.when(F.col("event_type") == "view", F.array(F.lit("value"))).otherwise(F.expr("cast(array() as array<string>)"))
    return _chain(fold(None, _events(spark, sf_dir, cfg, absent), cfg, 1), cfg)


GATED = TableConfig("customer", ("c_custkey",), (("c_custkey", "long"), ("c_name", "string"), ("c_acctbal", "double"), ("c_mktsegment", "string")), gates=(Gate("c_custkey", "not_null"), Gate("c_acctbal", "between 0 and 9000"), Gate("c_mktsegment", "in (BUILDING, 'MACHINERY', AUTOMOBILE)"), Gate("c_name", "matches Customer#[0-9]*[02468]")))


def quality_gates_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(from_frame(_table(spark, sf_dir, "customer"), GATED, F.col("c_custkey")), GATED, F.lit("2030-01-01").cast("timestamp"))
    return rows.select("c_custkey", F.col("_reason").alias("reason"))


def coerce_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props as a map of integers, and some of its values as other types, with what is refused."""
    raw = F.col("props")
    nested, bad = coerce(raw, parse_type("map<string,long>"))
    k = F.get_json_object(raw, "$.k")
    small, small_bad = coerce(k, parse_type("tinyint"))
    dec, dec_bad = coerce(F.concat(k, F.lit(".50")), parse_type("decimal(3,1)"))
    _, no_bad = coerce(F.concat(k, F.lit(".25")), parse_type("decimal(9,1)"))
    flag, flag_bad = coerce(k, parse_type("boolean"))
    t = _table(spark, sf_dir, "events").select("event_id", F.element_at(nested, "k").alias("k"), bad.alias("bad"), small.cast("int").alias("k_tiny"), small_bad.alias("tiny_bad"), dec.cast("double").alias("k_half"), dec_bad.alias("half_bad"), no_bad.alias("quarter_bad"), flag.alias("flag"), flag_bad.alias("flag_bad"))
    return t


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instant written in several forms is one instant."""
    t = F.col("ts").cast("timestamp")
    forms = {
        "iso": F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), "offset": F.concat(F.date_format(t + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")),
        "local": F.date_format(t, "yyyy-MM-dd HH:mm:ss"), "micros": F.unix_micros(F.date_trunc("second", t)).cast("string"), "day": F.date_format(t, "yyyy-MM-dd"), "none": F.lit("yesterday"),
    }
    return _plain(_table(spark, sf_dir, "events").select("event_id", *[parse_timestamp(x).alias(n) for n, x in forms.items()]))


#: Where the periods of full_snapshot_periods end.
PERIODS = ("1997-03-01", "1999-05-01", "2030-01-01")


def full_snapshot_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that order in a period are the whole population of it: others are deleted by absence."""
    cfg = TableConfig("population", ("o_custkey",), (("o_custkey", "long"), ("o_orderstatus", "string")))
    orders, log, begin = _table(spark, sf_dir, "orders"), None, "0001-01-01"
    for n, end in enumerate(PERIODS, 1):
        own = orders.where((F.col("o_orderdate") >= F.lit(begin).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")))
        pending = _pending(from_frame(own, cfg, F.col("o_orderkey")), cfg, end)
        if log is not None:
            log = settled(log)
            gone = missing_keys(reads.current(log, cfg), pending, cfg, F.lit(end).cast("timestamp"))
            pending = pending.select(*cfg.names, "_valid_from", "_delete", "_absent", "_ord").unionByName(gone.withColumn("_ord", F.lit(None).cast("bigint")))
        log, begin = fold(log, pending, cfg, n), end
    return _plain(log.select("o_custkey", "o_orderstatus", F.col("_valid_from").alias("valid_from"), F.col("_valid_to").alias("valid_to"), F.col("_op").alias("op"), F.col("_tx").alias("tx")))


def interval_import_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event holds for two hours: where the next one starts later there is a gap, and so a tombstone."""
    cfg = TableConfig("sessions", ("user_id",), (("user_id", "long"), ("event_type", "string")))
    df = _table(spark, sf_dir, "events")
    rows = from_frame(df, cfg, F.col("event_id")).withColumn("event_id", F.col("_ord"))
    times = df.select("event_id", F.col("ts").cast("timestamp").alias("_start"), (F.col("ts").cast("timestamp") + F.expr("interval 2 hours")).alias("_end"))
    pending = _pending(from_intervals(rows.join(times, "event_id").drop("event_id"), cfg), cfg)
    return _plain(fold(None, pending, cfg, 1).select("user_id", "event_type", F.col("_valid_from").alias("valid_from"), F.col("_valid_to").alias("valid_to"), F.col("_op").alias("op")))


LINES = TableConfig(
    "lines", ("l_orderkey", "l_linenumber"), (("l_orderkey", "long"), ("l_linenumber", "int"), ("l_partkey", "long"), ("l_quantity", "double"), ("l_returnflag", "string"), ("l_shipdate", "timestamp")),
    ignored_columns=("l_shipdate",), valid_time_mode="source_column", valid_time_column="l_shipdate",
)


def composite_key_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_partkey", "l_quantity", "l_returnflag")
    return _chain(fold(None, _pending(from_frame(_table(spark, sf_dir, "lineitem"), LINES, order), LINES), LINES, 1), LINES)


def nested_tracked_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as tracked values: a second batch repeats some vectors and changes others."""
    cfg = TableConfig("vectors", ("vec_id",), (("vec_id", "long"), ("embedding", "array<float>"), ("label", "int")))
    df = _table(spark, sf_dir, "embeddings")
    log = settled(fold(None, _pending(from_frame(df, cfg, F.col("vec_id")), cfg, "2024-01-01"), cfg, 1))
    changed = df.withColumn("embedding", F.when(F.pmod("vec_id", F.lit(3)) == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    log = fold(log, _pending(from_frame(changed, cfg, F.col("vec_id")), cfg, "2024-02-01"), cfg, 2)
    return _plain(log.select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), "label", F.col("_valid_from").alias("valid_from"), F.col("_valid_to").alias("valid_to"), F.col("_op").alias("op"), F.col("_tx").alias("tx")))


def _published(log: DataFrame, cfg: TableConfig) -> DataFrame:
    out = render(log, cfg)
    return _plain(out.drop(cfg.valid_time_column).withColumnRenamed("_tx_time", "tx"))


def publish_bitemporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(_beliefs(spark, sf_dir, of=2), ORDERS)


def publish_databricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = _with(EVENTS, column_style="databricks")
    return _published(fold(None, _events(spark, sf_dir, cfg), cfg, 1), cfg)


def publish_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = _with(ORDERS, scd2_start="EFF_START_DT", scd2_end="EFF_END_DT", include_ops=False)
    return _published(_first(spark, sf_dir, cfg), cfg)


def finalize_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consolidate(render(_beliefs(spark, sf_dir), ORDERS), ORDERS).where("_is_current")
    return _plain(out.select("o_custkey", "o_orderstatus", "o_orderpriority", F.col("_valid_from").alias("valid_from"), F.col("_op").alias("op")))


def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.verify_counts(_beliefs(spark, sf_dir, of=2), ORDERS)


def asof_join_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the status that their customer had when they shipped."""
    facts = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = reads.join_as_of(facts.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_custkey"), _first(spark, sf_dir), ORDERS, F.col("l_shipdate").cast("timestamp"))
    return _plain(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("_valid_from").alias("valid_from")))


def multi_get_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return _chain(reads.many(_first(spark, sf_dir), ORDERS, keys), ORDERS)


def substring_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scd2_current_orders(spark, sf_dir).select("o_custkey", "o_orderstatus", "o_orderpriority")
    return reads.rows_containing(rows, "URGENT")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of current rows: the limit is what the operator is."""
    rows = scd2_current_orders(spark, sf_dir).select("o_custkey", "o_orderstatus", "o_orderpriority")
    return rows.orderBy("o_custkey").offset(20).limit(10)


def publish_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(_first(spark, sf_dir), ORDERS).groupBy("o_orderstatus", "_op").agg(F.count("*").alias("n")).withColumnRenamed("_op", "op")


QUERIES = {
    f.__name__: f
    for f in (
        scd2_chain_orders, scd2_current_orders, scd2_asof_orders, scd2_history_beliefs, bitemporal_asof, latest_beliefs, late_split_counts, late_reject_counts, late_quarantine_rows, dup_reject,
        soft_delete_events, delete_ignore_events, reinsert_ops, carry_forward_events, quality_gates_customer, coerce_json_props, parse_timestamps, full_snapshot_periods, interval_import_gaps,
        composite_key_lineitem, nested_tracked_embeddings, publish_bitemporal, publish_databricks, publish_custom, finalize_current, verify_counts, asof_join_lineitem, multi_get_orders,
        substring_rows, page_rows, publish_partitions,
    )
}
