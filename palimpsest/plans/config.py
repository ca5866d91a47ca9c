"""What a table is declared to be, and what may change about it."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

from .types import NAME, ConfigError, declaration, is_scalar, parse_type

CHOICES = {
    "late_policy": ("split", "reject", "quarantine"),
    "same_batch_duplicates": ("last_wins", "reject"),
    "deletes": ("soft", "ignore"),
    "on_row_error": ("fail_batch", "skip_rows", "quarantine"),
    "absent_columns": ("null", "carry_forward"),
    "valid_time_mode": ("load_time", "source_column"),
    "column_style": ("bitemporal", "databricks"),
}


@dataclass(frozen=True)
class Gate:
    """not_null | between a and b | matches <regex> | in (a, b, ...)."""

    column: str
    rule: str

    @property
    def parsed(self) -> tuple:
        rule = self.rule.strip()
        if re.fullmatch(r"not[_ ]null", rule, re.I):
            return ("not_null",)
        if m := re.fullmatch(r"between\s+(\S+)\s+and\s+(\S+)", rule, re.I):
            try:
                low, high = Decimal(m[1]), Decimal(m[2])
            except InvalidOperation as e:
                raise ConfigError(f"between needs two numbers: {rule}") from e
            if low > high:
                raise ConfigError(f"between's least exceeds its most: {rule}")
            return ("between", low, high)
        if m := re.fullmatch(r"matches\s+(.+)", rule, re.I | re.S):
            try:
                re.compile(m[1])
            except re.error as e:
                raise ConfigError(f"not a regular expression: {m[1]}") from e
            return ("matches", m[1])
        if m := re.fullmatch(r"in\s*\((.*)\)", rule, re.I | re.S):
            items = [x.strip() for x in m[1].split(",")]
            return ("in", tuple(x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x for x in items))
        raise ConfigError(f"unknown quality rule: {rule}")


@dataclass(frozen=True)
class TableConfig:
    table: str
    business_key: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]  # name, type declaration
    tracked_columns: tuple[str, ...] = ()
    ignored_columns: tuple[str, ...] = ()
    valid_time_mode: str = "load_time"
    valid_time_column: str | None = None
    late_policy: str = "split"
    same_batch_duplicates: str = "last_wins"
    deletes: str = "soft"
    on_row_error: str = "skip_rows"
    gates: tuple[Gate, ...] = ()
    absent_columns: str = "null"
    publish_location: str | None = None
    partition_by: tuple[str, ...] = ()
    column_style: str = "bitemporal"
    scd2_start: str | None = None
    scd2_end: str | None = None
    include_ops: bool | None = None
    schema_version: int = 1
    history: tuple[tuple[tuple[str, str], ...], ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        names = [n for n, _ in self.columns]
        kinds = {n: parse_type(t) for n, t in self.columns}
        if not NAME.match(self.table or ""):
            raise ConfigError(f"not a table name: {self.table!r}")
        if not names:
            raise ConfigError("a schema needs columns")
        for n in names:
            if not NAME.match(n) or n.startswith("_"):
                raise ConfigError(f"not a column name, or reserved: {n!r}")
        if len(set(map(str.lower, names))) != len(names):
            raise ConfigError("column names must be unique")
        if not self.business_key or len(set(self.business_key)) != len(self.business_key):
            raise ConfigError("a business key needs one or more different columns")
        for what, own in (("business_key", self.business_key), ("tracked_columns", self.tracked_columns), ("ignored_columns", self.ignored_columns), ("partition_by", self.partition_by), ("quality_gates", [g.column for g in self.gates])):
            for c in own:
                if c not in kinds:
                    raise ConfigError(f"{what} names no column of the schema: {c}")
        for c in (*self.business_key, *self.partition_by):
            if not is_scalar(kinds[c]):
                raise ConfigError(f"{c} must be scalar")
        if set(self.ignored_columns) & set(self.business_key):
            raise ConfigError("a key column can't be ignored")
        if set(self.tracked_columns) & set(self.ignored_columns):
            raise ConfigError("a column is tracked or ignored, not both")
        for what, choices in CHOICES.items():
            if getattr(self, what) not in choices:
                raise ConfigError(f"{what} is one of {', '.join(choices)}")
        if self.valid_time_mode == "source_column":
            if self.valid_time_column not in kinds:
                raise ConfigError("valid_time.column must name a column of the schema")
            if not isinstance(kinds[self.valid_time_column], T.TimestampType | T.TimestampNTZType | T.DateType):
                raise ConfigError("the valid time column must be a timestamp, timestamp_ntz or date")
        if (self.scd2_start is None) != (self.scd2_end is None) or (self.scd2_start and self.scd2_start == self.scd2_end):
            raise ConfigError("scd2_columns need a start and another end")
        if self.scd2_start and {self.scd2_start, self.scd2_end} & set(names):
            raise ConfigError("scd2_columns must not be columns of the schema")
        for g in self.gates:
            g.parsed  # noqa: B018  a rule that can't be read is refused here

    @property
    def types(self) -> dict[str, T.DataType]:
        return {n: parse_type(t) for n, t in self.columns}

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    @property
    def payload(self) -> list[str]:
        """All columns but the key's."""
        return [n for n in self.names if n not in self.business_key]

    @property
    def tracked(self) -> list[str]:
        """The columns whose change makes a version: as declared, else all that are neither key nor ignored."""
        if self.tracked_columns:
            return [n for n in self.payload if n in self.tracked_columns]
        return [n for n in self.payload if n not in self.ignored_columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, parse_type(t)) for n, t in self.columns])

    @property
    def start_end_ops(self) -> tuple[str, str, bool]:
        """What published start and end are called, and whether operations and tombstones are published."""
        if self.scd2_start:
            return self.scd2_start, self.scd2_end, bool(self.include_ops)
        if self.column_style == "databricks":
            return "__START_AT", "__END_AT", bool(self.include_ops)
        return "_valid_from", "_valid_to", True if self.include_ops is None else self.include_ops

    def to_dict(self) -> dict:
        out = {k: v for k, v in self.__dict__.items() if k != "gates"}
        return json.loads(json.dumps(out | {"gates": [[g.column, g.rule] for g in self.gates], "columns": [[n, declaration(parse_type(t))] for n, t in self.columns]}))

    @staticmethod
    def from_dict(d: dict) -> TableConfig:
        deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
        d = {k: deep(v) for k, v in d.items()}
        return TableConfig(**d | {"gates": tuple(Gate(*g) for g in d.get("gates", ()))})

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]


def from_yaml(text: str) -> TableConfig:
    """A table's declaration in YAML; unknown and duplicate keys are refused."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=deep) for k, _ in node.value]
        if len(set(map(str, keys))) != len(keys):
            raise ConfigError(f"a key appears twice near line {node.start_mark.line + 1}")
        return dict(zip(keys, (loader.construct_object(v, deep=True) for _, v in node.value), strict=True))

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    try:
        return from_mapping(yaml.load(text, Loader))  # noqa: S506  a SafeLoader
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e


def from_mapping(d: dict) -> TableConfig:
    if not isinstance(d, dict):
        raise ConfigError("a table's declaration is a mapping")
    known = {"table", "business_key", "schema", "schema_version", "tracked_columns", "ignored_columns", "valid_time", "late_arrival", "deletes", "on_row_error", "quality_gates", "absent_columns", "publish"}
    if extra := set(d) - known:
        raise ConfigError(f"unknown keys: {', '.join(sorted(map(str, extra)))}")
    if d.get("schema_version", 1) != 1:
        raise ConfigError("schema_version is counted by the engine")
    if isinstance(d.get("late_arrival"), str):
        d = d | {"late_arrival": {"policy": d["late_arrival"]}}
    several = lambda x: () if x is None else (x,) if isinstance(x, str) else tuple(x)
    vt, late, pub = d.get("valid_time") or {}, d.get("late_arrival") or {}, d.get("publish") or {}
    deletes = d.get("deletes") or {}
    style = str(pub.get("column_style", "bitemporal")).lower()
    ends = pub.get("scd2_columns") or {}
    if pub.get("enabled") and not pub.get("location"):
        raise ConfigError("publish needs a location")
    error = str(d.get("on_row_error", "skip_rows")).lower()
    return TableConfig(
        table=d.get("table"),
        business_key=several(d.get("business_key")),
        columns=tuple((c["name"], str(c["type"])) for c in d.get("schema") or ()),
        tracked_columns=several(d.get("tracked_columns")),
        ignored_columns=several(d.get("ignored_columns")),
        valid_time_mode=vt.get("mode", "load_time"),
        valid_time_column=vt.get("column"),
        late_policy=late.get("policy", "split"),
        same_batch_duplicates=late.get("same_batch_duplicates", "last_wins"),
        deletes=deletes if isinstance(deletes, str) else deletes.get("mode", "soft"),
        on_row_error="skip_rows" if error == "skip" else error,
        gates=tuple(Gate(g["column"], str(g["rule"])) for g in d.get("quality_gates") or ()),
        absent_columns=str(d.get("absent_columns") or "null"),
        publish_location=pub.get("location") if pub.get("enabled", bool(pub)) else None,
        partition_by=several(pub.get("partition_by")),
        column_style="bitemporal" if style in ("native", "native bitemporal") else style,
        scd2_start=ends.get("start"),
        scd2_end=ends.get("end"),
        include_ops=ends.get("include_ops"),
    )


def altered(old: TableConfig, new: TableConfig) -> TableConfig:
    """new as the next version of old: columns may be added at the end, and policies may change."""
    if new.table != old.table:
        raise ConfigError("a table keeps its name")
    if new.business_key != old.business_key:
        raise ConfigError("a table keeps its business key")
    before = [(n, parse_type(t)) for n, t in old.columns]
    after = [(n, parse_type(t)) for n, t in new.columns]
    if after[: len(before)] != before:
        raise ConfigError("columns can only be added at the end; none may go, move or change its type")
    grown = len(after) > len(before)
    return replace(new, schema_version=old.schema_version + grown, history=(*old.history, old.columns) if grown else old.history)
