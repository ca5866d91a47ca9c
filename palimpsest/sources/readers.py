"""Files of changes: JSON, JSON Lines and CSV, read by executors; envelopes and documents of several tables, which are small, by the driver.

What comes out are raw rows (`raw`, `_delete`, `_override`, `_ord`): a map keeps the difference between a column that is missing and one that is null, and _ord keeps the order of the input.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.config import ConfigError
from .arrays import elements, heads

DELETES, UPSERTS = ("delete", "d", "remove", "del"), ("", "upsert", "u", "insert", "i", "update")
ENVELOPE = {"table", "load_id", "effective_at", "defaults", "metadata", "records"}
#: JSON and nothing else.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
FORMATS = {".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json"}


@dataclass
class Input:
    """What a file holds: raw rows by table (None: the caller names it), and what an envelope says about them."""

    rows: dict[str | None, DataFrame]
    load_id: str | None = None
    effective_at: str | None = None
    metadata: dict = field(default_factory=dict)


def format_of(path: str) -> str:
    for end, kind in FORMATS.items():
        if path.lower().endswith(end):
            return kind
    raise ConfigError(f"can't tell the format from the name (one of {', '.join(FORMATS)}): {path}")


def resolve_load_id(flag: str | None, envelope: str | None) -> str | None:
    if flag and envelope and flag != envelope:
        raise ConfigError(f"two load ids: {flag} and, in the envelope, {envelope}")
    return flag or envelope


def parse_key(words: list[str]) -> dict[str, str]:
    """column=value words, cut at the first equals sign."""
    out = {}
    for w in words:
        name, eq, value = w.partition("=")
        if not eq or not name:
            raise ConfigError(f"a key is column=value: {w}")
        out[name] = value
    return out


def decode_ops(rows: DataFrame) -> DataFrame:
    """rows (raw, _ord) with _delete from the raw column _op, which goes; an unknown operation is an error."""
    op = F.lower(F.trim(F.coalesce(F.element_at("raw", "_op"), F.lit(""))))
    delete = F.when(op.isin(*DELETES), True).when(op.isin(*UPSERTS), False).otherwise(F.raise_error(F.concat(F.lit("unknown _op: "), op)).cast("boolean"))
    return rows.select(F.map_filter("raw", lambda k, v: k != "_op").alias("raw"), delete.alias("_delete"), F.lit(None).cast("timestamp").alias("_override"), "_ord")


def _order(df: DataFrame) -> DataFrame:
    """df (with _metadata) and _ord: the file and the row's place in it, blank ones counted, however the file was split.

    Spark numbers the rows of a split; how many rows the splits before hold comes from one count, a row for each split.
    """
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    blocks = placed.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    blocks = blocks.select("_file", "_block", "_first", before.alias("_before"))
    line = F.col("_id") - F.col("_first") + F.col("_before")
    return placed.join(blocks, ["_file", "_block"]).withColumn("_ord", F.struct(F.col("_file").alias("file"), line.alias("row"))).drop("_file", "_block", "_id", "_first", "_before")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; blank lines are skipped, and a line that is no object is an error with its number and text."""
    lines = _order(spark.read.text(path).select("value", "_metadata")).where(F.trim("value") != "")
    raw = F.from_json("value", "map<string,string>", STRICT)
    # Objects within objects that are cut, and what comes after an object, show only when the line is read as the one element of an array.
    whole = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<map<string,string>>", STRICT)
    sound = raw.isNotNull() & (F.size(whole) == 1) & F.element_at(whole, 1).isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    wrong = F.raise_error(F.concat(F.lit("line "), F.col("_ord.row") + 1, F.lit(": not a JSON object: "), F.left("value", F.lit(200)))).cast("map<string,string>")
    return decode_ops(lines.select(F.when(F.coalesce(sound, F.lit(False)), raw).otherwise(wrong).alias("raw"), "_ord"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header, quotes by RFC 4180, lines within quotes; an empty cell is null, and a ragged line an error."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", inferSchema=False, enforceSchema=False)
    names = df.columns
    df = _order(df.select("*", "_metadata"))
    pairs = [x for c in names for x in (F.lit(c.strip()), F.nullif(F.col(f"`{c}`"), F.lit("")))]
    return decode_ops(df.select(F.create_map(*pairs).alias("raw"), "_ord"))


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value) if isinstance(value, dict | list | bool) else str(value)


def from_records(spark: SparkSession, records: list, defaults: dict | None = None) -> DataFrame:
    """Objects that the driver holds."""
    if not all(isinstance(r, dict) for r in records):
        raise ConfigError("a record is an object")
    rows = [({k: _text(v) for k, v in ((defaults or {}) | r).items()}, n) for n, r in enumerate(records)]
    return decode_ops(spark.createDataFrame(rows, "raw map<string,string>, _ord bigint"))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one array of objects, or a folder of such; executors take them apart, split by split. A file that is cut off, has more behind the array or an element that is no object is an error: nothing of it is rows."""
    own = elements(spark, path)
    before = lambda sign: r"^[ \t\r\n]*" + sign + r"[ \t\r\n]*\{"
    led = F.when(F.col("row") == 0, F.col("text").rlike(before(r"\["))).otherwise(F.col("text").rlike(before(",")))
    bare = F.when(F.col("row") == 0, F.regexp_replace("text", before(r"\["), "{")).otherwise(F.regexp_replace("text", before(","), "{"))
    # As the one element of an array: what follows the object then breaks it or is a second element.
    told = own.select("file", "row", led.alias("led"), F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<map<string,string>>", STRICT | {"mode": "FAILFAST"}).alias("whole"))
    sound = F.col("led") & (F.size("whole") == 1) & F.element_at("whole", 1).isNotNull()
    wrong = F.raise_error(F.concat(F.lit("not one array of objects: "), F.col("file"), F.lit(", element "), F.col("row"))).cast("map<string,string>")
    return decode_ops(told.select(F.when(F.coalesce(sound, F.lit(False)), F.element_at("whole", 1)).otherwise(wrong).alias("raw"), F.struct("file", "row").alias("_ord")))


def parse_document(spark: SparkSession, text: str) -> Input:
    """A JSON text: an array of rows, an envelope with records, or an object of tables."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not JSON: {e}") from e
    if isinstance(doc, list):
        return Input({None: from_records(spark, doc)})
    if not isinstance(doc, dict) or not doc:
        raise ConfigError("a document is an array of rows, an envelope or an object of tables")
    if isinstance(doc.get("records"), list):
        table = doc.get("table")
        more = {k: v for k, v in doc.items() if k not in ENVELOPE}
        return Input({table: from_records(spark, doc["records"], doc.get("defaults"))}, doc.get("load_id"), doc.get("effective_at"), (doc.get("metadata") or {}) | more)
    if any(not isinstance(v, list) for v in doc.values()):
        raise ConfigError("each table's value is an array of rows")
    return Input({t: from_records(spark, rows) for t, rows in doc.items()})


def read(spark: SparkSession, path: str, kind: str | None = None) -> Input:
    """A file by its kind, or by its name's end."""
    kind = kind or format_of(path)
    if kind == "jsonl":
        return Input({None: read_jsonl(spark, path)})
    if kind == "csv":
        return Input({None: read_csv(spark, path)})
    found = {r["head"]: r["n"] for r in heads(spark, path).groupBy("head").agg(F.count("*").alias("n")).collect()}  # a row for each first character
    if set(found) == {"["}:
        return Input({None: read_array(spark, path)})
    if sum(found.values()) > 1:
        raise ConfigError(f"a folder of JSON files holds arrays of rows only: {path}")
    return parse_document(spark, spark.read.text(path, wholetext=True).first()[0] if found else "")


def read_string(spark: SparkSession, text: str, kind: str = "jsonl") -> Input:
    """A text that the driver holds, as from standard input or a request."""
    if kind == "json":
        return parse_document(spark, text)
    if kind == "csv":
        import csv
        import io

        lines = list(csv.reader(io.StringIO(text), strict=True))
        header = [c.strip() for c in lines[0]] if lines else []
        if any(len(x) not in (0, len(header)) for x in lines):
            raise ConfigError("a line has more or fewer cells than the header")
        return Input({None: from_records(spark, [dict(zip(header, (v or None for v in x), strict=True)) for x in lines[1:] if x])})
    records = []
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                records.append(json.loads(line))
            except ValueError as e:
                raise ConfigError(f"line {n}: {e}") from e
    return Input({None: from_records(spark, records)})


def instant(text: str | None) -> datetime | None:
    from datetime import UTC

    if text is None:
        return None
    t = datetime.fromisoformat(text)
    return (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC)
