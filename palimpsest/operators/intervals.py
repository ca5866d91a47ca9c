"""Rows that come as intervals with a start and an end become changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import TableConfig


def from_intervals(rows: DataFrame, cfg: TableConfig, start: str = "_start", end: str = "_end", order: str = "_ord") -> DataFrame:
    """Staged rows: an upsert at each start, and a delete at an end that no next start follows directly. Rows without start pass as they are; an end not after its start is refused."""
    w = Window.partitionBy(*cfg.business_key, F.col(start).isNull()).orderBy(start, order)
    checked = rows.withColumn(end, F.when(F.col(end) <= F.col(start), F.raise_error(F.concat(F.lit("interval ends before it starts: "), F.col(end).cast("string")))).otherwise(F.col(end)))
    after = checked.withColumn("_next", F.lead(start).over(w))
    closes = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col("_next").isNull() | (F.col(end) < F.col("_next")))
    upsert = F.struct(F.coalesce(F.col(start), F.col("_override")).alias("at"), F.col("_delete").alias("gone"), F.lit(0).alias("n"))
    delete = F.struct(F.col(end).alias("at"), F.lit(True).alias("gone"), F.lit(1).alias("n"))
    out = after.withColumn("_e", F.explode(F.when(closes, F.array(upsert, delete)).otherwise(F.array(upsert))))
    return out.withColumns({"_override": F.col("_e.at"), "_delete": F.col("_e.gone"), "_ord": F.struct(F.col(order).alias("o"), F.col("_e.n").alias("n"))}).drop("_e", "_next", start, end)
