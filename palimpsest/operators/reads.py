"""Reads over a log of beliefs: aggregates by key that combine before they shuffle; filters on keys and times reach the scan.

A log has the schema's columns, _valid_from, _valid_to (null: open), _op, and _tx (when it was learned, larger is later).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import ConfigError, TableConfig
from .decide import DELETE


def _newest(log: DataFrame, by: list[str], order: Column) -> DataFrame:
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def known_at(log: DataFrame, tx) -> DataFrame:
    return log if tx is None else log.where(F.col("_tx") <= F.lit(tx))


def latest(log: DataFrame, cfg: TableConfig, tx=None) -> DataFrame:
    """The newest belief of each (key, valid time)."""
    return _newest(known_at(log, tx), [*cfg.business_key, "_valid_from"], F.col("_tx"))


def as_of(log: DataFrame, cfg: TableConfig, valid_time, tx=None) -> DataFrame:
    """What was true at valid_time as known at tx (now if None): the newest belief of the last version that starts by then, if it lives and reaches valid_time.

    There is no fallback to an earlier version.
    """
    at = F.lit(valid_time).cast("timestamp") if not isinstance(valid_time, Column) else valid_time
    floor = _newest(known_at(log, tx).where(F.col("_valid_from") <= at), list(cfg.business_key), F.struct("_valid_from", "_tx"))
    return floor.where((F.col("_op") != DELETE) & (F.col("_valid_to").isNull() | (at < F.col("_valid_to"))))


def with_current(rows: DataFrame, tx=None) -> DataFrame:
    """as_of()'s rows with _is_current: whether the version is open, if the newest beliefs were asked for; never, if a transaction time was given."""
    return rows.withColumn("_is_current", F.col("_valid_to").isNull() if tx is None else F.lit(False))


def current(log: DataFrame, cfg: TableConfig) -> DataFrame:
    """Entities whose newest version is open and alive."""
    return _newest(log, list(cfg.business_key), F.struct("_valid_from", "_tx")).where((F.col("_op") != DELETE) & F.col("_valid_to").isNull())


def history(log: DataFrame, cfg: TableConfig) -> DataFrame:
    """Every belief, the newest of each entity first; _is_current marks the first if it is open and alive."""
    w = Window.partitionBy(*cfg.business_key).orderBy(F.desc("_valid_from"), F.desc("_tx"))
    first = (F.row_number().over(w) == 1) & (F.col("_op") != DELETE) & F.col("_valid_to").isNull()
    return log.withColumn("_is_current", first)


def by_key(log: DataFrame, **key) -> DataFrame:
    """The rows of one entity; the filter reaches the scan."""
    for c, v in key.items():
        log = log.where(F.col(c) == F.lit(v))
    return log


def by_prefix(log: DataFrame, cfg: TableConfig, **key) -> DataFrame:
    """The rows of all entities whose first key columns have these values."""
    if tuple(key) != cfg.business_key[: len(key)]:
        raise ConfigError(f"a prefix names the first of {', '.join(cfg.business_key)}, in order")
    return by_key(log, **key)


def many(log: DataFrame, cfg: TableConfig, keys: DataFrame) -> DataFrame:
    """A row for each of keys, with nulls where there is no current entity."""
    return keys.join(current(log, cfg), list(cfg.business_key), "left")


def join_as_of(facts: DataFrame, log: DataFrame, cfg: TableConfig, time: Column, tx=None) -> DataFrame:
    """facts with the version that was valid at their time; the facts' columns named like the key join to it.

    Versions and facts of a key are one line in order of time, and each fact takes the last version before it: one exchange, and no pair of a fact with a version that it does not get. A fact without key or time gets none.
    """
    key, rest = list(cfg.business_key), [c for c in [*cfg.names, "_valid_from", "_valid_to"] if c not in cfg.business_key]
    version = F.struct(*[F.col(c) for c in rest], F.col("_op"))
    versions = latest(log, cfg, tx).select(*key, F.col("_valid_from").alias("_at"), version.alias("_version"))
    line = facts.select(*[F.col(c).cast(cfg.types[c]).alias(c) for c in key], time.cast("timestamp").alias("_at"), F.struct("*").alias("_fact")).unionByName(versions, allowMissingColumns=True)
    # A version counts from its own instant on, so it comes before facts of that instant.
    w = Window.partitionBy(*key).orderBy(F.col("_at").asc_nulls_first(), F.col("_version").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("_met", F.last("_version", ignorenulls=True).over(w)).where("_fact is not null")
    known = F.col("_at").isNotNull()
    for c in key:
        known = known & F.col(c).isNotNull()
    valid = known & (F.col("_met._op") != DELETE) & (F.col("_met._valid_to").isNull() | (F.col("_at") < F.col("_met._valid_to")))
    return met.select("_fact.*", *[F.when(valid, F.col("_met").getField(c)).alias(c) for c in rest])


def rows_containing(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON has text in it, whatever the case."""
    return rows.where(F.lower(F.to_json(F.struct("*"))).contains(text.lower()))


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> tuple[list, bool]:
    """(rows of one page, whether there are more); at most 1000."""
    n = max(0, min(limit, 1000))
    found = rows.orderBy(*order).offset(offset).limit(n + 1).collect()
    return found[:n], len(found) > n


def fingerprint(log: DataFrame) -> int:
    """A sum over all beliefs that does not depend on their order."""
    parts = [F.coalesce(F.to_json(F.struct("*")), F.lit(""))]
    total = log.select(F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))).first()[0] or 0
    return int(total) % (1 << 64)


def verify_counts(log: DataFrame, cfg: TableConfig) -> DataFrame:
    """version_records, entities, current_rows, in one pass by key."""
    per = log.groupBy(*cfg.business_key).agg(F.count("*").alias("n"), F.max_by(F.struct("_op", "_valid_to"), F.struct("_valid_from", "_tx")).alias("r"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("version_records"), F.count("*").alias("entities"), F.count(F.when((F.col("r._op") != DELETE) & F.col("r._valid_to").isNull(), 1)).alias("current_rows"))
