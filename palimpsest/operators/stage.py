"""Staging: raw rows become typed rows with a valid time, or a reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import coerce
from ..functions.gates import first_failure
from ..plans.config import TableConfig

#: What raw rows carry besides `raw`: whether the row deletes, a valid time that overrides, and its place in the input.
RAW = "raw map<string,string>, _delete boolean, _override timestamp"


def from_frame(df: DataFrame, cfg: TableConfig, order: Column | None = None, delete: Column | None = None, override: Column | None = None, absent: Column | None = None) -> DataFrame:
    """Typed rows to be staged: columns of the schema by name (others are left out; missing ones are absent). order: any orderable expression that is unique; without one rows have no order, and of rows at one instant their contents decide, however they were partitioned."""
    have = set(df.columns)
    missing = [c for c in cfg.names if c not in have]
    gone = F.array(*map(F.lit, missing)).cast("array<string>")
    if absent is not None:
        gone = F.array_union(gone, absent)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(cfg.types[c]).alias(c) for c in cfg.names],
        F.coalesce(delete if delete is not None else F.lit(False), F.lit(False)).alias("_delete"),
        (override if override is not None else F.lit(None)).cast("timestamp").alias("_override"),
        gone.alias("_absent"),
        F.lit(None).cast("string").alias("_bad"),
        (order if order is not None else F.xxhash64(F.to_json(F.struct("*")))).alias("_ord"),
        F.lit(None).cast("map<string,string>").alias("_raw"),
    )


def from_raw(df: DataFrame, cfg: TableConfig, *more: str) -> DataFrame:
    """Rows of RAW and _ord, coerced; _bad names the first column whose value was refused. more: columns that stay as they are."""
    made = {c: coerce(F.element_at("raw", c), cfg.types[c]) for c in cfg.names}
    bad = F.lit(None).cast("string")
    for c in reversed(cfg.names):
        bad = F.when(made[c][1], F.concat(F.lit(f"{c}: not a {dict(cfg.columns)[c]}: "), F.element_at("raw", c))).otherwise(bad)
    names = F.array(*map(F.lit, cfg.names))
    return df.select(
        *[made[c][0].alias(c) for c in cfg.names], F.coalesce("_delete", F.lit(False)).alias("_delete"), F.col("_override"),
        F.filter(names, lambda c: ~F.map_contains_key("raw", c)).alias("_absent"), bad.alias("_bad"), "_ord", F.col("raw").alias("_raw"), *more,
    )


def as_instant(value: Column, kind: T.DataType) -> Column:
    """A valid-time value as an instant in UTC; a date is its midnight."""
    return F.timestamp_micros(F.unix_date(value).cast("bigint") * 86_400_000_000) if isinstance(kind, T.DateType) else value.cast("timestamp")


def stage(rows: DataFrame, cfg: TableConfig, tx_time: Column) -> DataFrame:
    """rows with _valid_from and _reason (null if the row is sound). Order of checks: values, key, valid time, gates."""
    key_null = F.lit(None).cast("string")
    for c in reversed(cfg.business_key):
        key_null = F.when(F.col(c).isNull(), F.lit(f"business key column {c} is null")).otherwise(key_null)
    if cfg.valid_time_mode == "source_column":
        source = as_instant(F.col(cfg.valid_time_column), cfg.types[cfg.valid_time_column])
        at = F.coalesce("_override", source)
    else:
        at = F.coalesce("_override", tx_time)
    keep = cfg.absent_columns == "carry_forward"
    absent = F.when(~F.col("_delete"), F.col("_absent")) if keep else None
    values = {c: F.col(c) for c in cfg.names}
    gated = F.when(~F.col("_delete"), first_failure(cfg.gates, values, cfg.types, F.coalesce(absent, F.expr("cast(array() as array<string>)")) if keep else None)) if cfg.gates else F.lit(None).cast("string")
    # Keys are gated for deletes too: they name what is deleted.
    key_gates = tuple(g for g in cfg.gates if g.column in cfg.business_key)
    if key_gates:
        gated = F.when(F.col("_delete"), first_failure(key_gates, values, cfg.types)).otherwise(gated)
    return rows.withColumn("_valid_from", at).withColumns({
        "_reason": F.coalesce("_bad", key_null, F.when(F.col("_valid_from").isNull(), F.lit("valid time is null")), gated),
        "_absent": F.coalesce(absent, F.expr("cast(array() as array<string>)")) if keep else F.expr("cast(array() as array<string>)"),
    })


def with_effective_time(rows: DataFrame, effective_at: Column, cfg: TableConfig) -> DataFrame:
    """A default valid time for rows that bring none of their own."""
    own = F.col("_override")
    if cfg.valid_time_mode == "source_column":
        own = F.coalesce(own, F.when(F.col(cfg.valid_time_column).isNotNull(), as_instant(F.col(cfg.valid_time_column), cfg.types[cfg.valid_time_column])))
    return rows.withColumn("_override", F.coalesce(own, effective_at))

