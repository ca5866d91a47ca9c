"""The type grammar of table declarations, and its Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Scalar names and aliases.
SCALARS = {
    "string": T.StringType, "text": T.StringType,
    "long": T.LongType, "bigint": T.LongType, "int": T.IntegerType, "integer": T.IntegerType,
    "smallint": T.ShortType, "short": T.ShortType, "tinyint": T.ByteType, "byte": T.ByteType,
    "double": T.DoubleType, "float": T.FloatType, "real": T.FloatType,
    "boolean": T.BooleanType, "bool": T.BooleanType,
    "date": T.DateType, "timestamp": T.TimestampType, "timestamp_ntz": T.TimestampNTZType,
    "bytes": T.BinaryType, "binary": T.BinaryType,
}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class ConfigError(ValueError):
    """A declaration that cannot be accepted."""


def split_top(text: str, at: str = ",") -> list[str]:
    """text cut at `at` outside brackets."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "<("
        depth -= c in ">)"
        if c == at and depth == 0:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def parse_type(text: str) -> T.DataType:
    """string | char(n) | varchar(n) | decimal(p,s) | array<T> | map<K,V> | struct<a:T,...> and the other SCALARS."""
    t = text.strip().lower()
    if t in SCALARS:
        return SCALARS[t]()
    if re.fullmatch(r"(var)?char\s*\(\s*\d+\s*\)", t):
        return T.StringType()
    if m := re.fullmatch(r"(?:decimal|numeric)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", t):
        p, s = int(m[1] or 38), int(m[2] or 0)
        if not (1 <= p <= 38 and 0 <= s <= p):
            raise ConfigError(f"decimal({p},{s}): precision is 1 to 38 and scale 0 to precision")
        return T.DecimalType(p, s)
    if m := re.fullmatch(r"(array|map|struct)\s*<(.*)>", text.strip(), re.I | re.S):
        kind, inner = m[1].lower(), split_top(m[2])
        if kind == "array" and len(inner) == 1:
            return T.ArrayType(parse_type(inner[0]))
        if kind == "map" and len(inner) == 2:
            key = parse_type(inner[0])
            if not is_scalar(key):
                raise ConfigError(f"a map's key must be scalar: {text}")
            return T.MapType(key, parse_type(inner[1]))
        if kind == "struct":
            fields = [split_top(f, ":") for f in inner]
            names = [f[0].strip() for f in fields]
            if any(len(f) != 2 for f in fields) or len(set(map(str.lower, names))) != len(names) or not all(map(NAME.match, names)):
                raise ConfigError(f"struct fields are name:type with unique names: {text}")
            return T.StructType([T.StructField(n, parse_type(f[1])) for n, f in zip(names, fields, strict=True)])
    raise ConfigError(f"unknown type: {text}")


def is_scalar(t: T.DataType) -> bool:
    return not isinstance(t, T.ArrayType | T.MapType | T.StructType)


def declaration(t: T.DataType) -> str:
    """The text that parses to t."""
    if isinstance(t, T.ArrayType):
        return f"array<{declaration(t.elementType)}>"
    if isinstance(t, T.MapType):
        return f"map<{declaration(t.keyType)},{declaration(t.valueType)}>"
    if isinstance(t, T.StructType):
        return f"struct<{','.join(f'{f.name}:{declaration(f.dataType)}' for f in t.fields)}>"
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    return next(n for n, kind in SCALARS.items() if type(t) is kind)
