"""From raw strings to declared types, exactly: a value that would be rounded, cut or guessed at is refused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
_WIDE = T.DecimalType(38, 18)


def parse_timestamp(raw: Column) -> Column:
    """ISO instants, offsets, local times (as UTC), dates, or microseconds since the epoch; null if it is none of these."""
    digits = raw.rlike(r"^\s*-?[0-9]{5,}\s*$")
    iso = raw.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?\s*(Z|[+-][0-9]{2}:?([0-9]{2})?)?)?\s*$")
    return F.when(digits, F.timestamp_micros(raw.try_cast("bigint"))).when(iso, raw.try_cast("timestamp"))


def coerce(raw: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(the value, whether raw holds something that is not one). An empty string is null but for strings."""
    if isinstance(kind, T.StringType):
        return raw, F.lit(False)
    some = raw.isNotNull() & (F.trim(raw) != "")
    text = F.when(some, F.trim(raw))
    if isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        exact = text.try_cast(_WIDE)
        whole = F.when(exact == F.floor(exact), exact.try_cast("bigint")).otherwise(text.try_cast("bigint"))
        value = whole if isinstance(kind, T.LongType) else whole.try_cast(kind)
    elif isinstance(kind, T.DoubleType | T.FloatType):
        value = text.try_cast(kind)
    elif isinstance(kind, T.BooleanType):
        low = F.lower(text)
        value = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    elif isinstance(kind, T.DateType):
        value = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date")).when(text.rlike(r"^-?[0-9]{1,7}$"), F.date_add(F.lit("1970-01-01").cast("date"), text.try_cast("int")))
    elif isinstance(kind, T.TimestampType):
        value = parse_timestamp(text)
    elif isinstance(kind, T.TimestampNTZType):
        value = parse_timestamp(text).cast("timestamp_ntz")
    elif isinstance(kind, T.DecimalType):
        rounded = text.try_cast(kind)
        fraction = F.length(F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)", 1), "0+$", ""))
        plain = text.rlike(r"^[+-]?[0-9]*\.?[0-9]*$")
        value = F.when(plain & (fraction <= kind.scale), rounded).when(~plain & (text.try_cast(_WIDE) == rounded), rounded)
    elif isinstance(kind, T.BinaryType):
        value = F.try_to_binary(text, F.lit("base64"))
    else:
        value = F.from_json(text, kind)
    return value, some & value.isNull()


def canonical(value: Column, kind: T.DataType) -> Column:
    """What a gate sees, as a string: dates as days, timestamps as microseconds since the epoch."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    return value.cast("string") if not isinstance(kind, T.ArrayType | T.MapType | T.StructType) else F.to_json(value)


def comparable(value: Column, kind: T.DataType) -> Column:
    """value in a form that <=> accepts and for which the order of a map's entries does not matter."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType) and _has_map(kind.elementType):
        return F.transform(value, lambda e: comparable(e, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(value.isNotNull(), F.struct(*[comparable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def render(value: Column, kind: T.DataType) -> Column:
    """JSON-friendly: dates and instants in ISO form, decimals as plain strings, bytes in base64."""
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.DateType | T.DecimalType):
        return value.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    return value
