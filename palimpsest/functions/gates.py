"""Quality gates as conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import Gate
from .coerce import canonical


def passes(gate: Gate, value: Column, kind: T.DataType) -> Column:
    """Whether value passes; null passes all but not_null."""
    what, *args = gate.parsed
    if what == "not_null":
        return value.isNotNull()
    text = canonical(value, kind)
    if what == "between":
        wide = T.DecimalType(38, 18)
        met = text.try_cast(wide).between(F.lit(str(args[0])).cast(wide), F.lit(str(args[1])).cast(wide))
    elif what == "matches":
        met = text.rlike(rf"\A(?:{args[0]})\z")
    else:
        met = text.isin(*args[0])
    return value.isNull() | F.coalesce(met, F.lit(False))


def first_failure(gates: tuple[Gate, ...], values: dict[str, Column], kinds: dict[str, T.DataType], absent: Column | None = None) -> Column:
    """The reason for the first gate that fails, or null. A column that the row leaves out to carry it forward is not gated."""
    out = F.lit(None).cast("string")
    for g in reversed(gates):
        failed = ~passes(g, values[g.column], kinds[g.column])
        if absent is not None:
            failed = failed & ~F.array_contains(absent, g.column)
        out = F.when(failed, F.lit(f"quality gate failed: {g.column} {g.rule}")).otherwise(out)
    return out
