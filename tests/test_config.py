import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.coerce import coerce, comparable
from palimpsest.functions.gates import passes
from palimpsest.plans.config import ConfigError, Gate, TableConfig, altered, from_yaml
from palimpsest.plans.runid import RunIds, parts
from palimpsest.plans.types import declaration, parse_type

YAML = """
table: vessel
business_key: hull_no
schema:
  - {name: hull_no, type: string}
  - {name: name, type: string}
  - {name: draught, type: double}
  - {name: tonnage, type: 'decimal(18,4)'}
  - {name: flag, type: string}
  - {name: surveyed, type: timestamp}
ignored_columns: [surveyed]
valid_time: {mode: source_column, column: surveyed}
quality_gates:
  - {column: hull_no, rule: not_null}
  - {column: flag, rule: 'in (DK, NO, SE)'}
"""


@pytest.mark.parametrize("text", ["string", "long", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz", "bytes", "decimal(18,4)", "array<struct<a:string,b:map<string,array<int>>>>"])
def test_types_round_trip(text):
    assert parse_type(declaration(parse_type(text))) == parse_type(text)


@pytest.mark.parametrize("text", ["interval", "variant", "void", "null", "decimal(39,0)", "decimal(5,6)", "array<", "map<array<int>,int>", "struct<a:int,a:int>", "struct<>", "strin"])
def test_types_refused(text):
    with pytest.raises(ConfigError):
        parse_type(text)


def test_yaml():
    cfg = from_yaml(YAML)
    assert cfg.tracked == ["name", "draught", "tonnage", "flag"]
    assert TableConfig.from_dict(cfg.to_dict()) == cfg and TableConfig.from_dict(cfg.to_dict()).hash == cfg.hash
    for bad in (YAML + "table: again\n", YAML.replace("not_null", "is nice"), YAML.replace("hull_no\n", "nobody\n", 1), YAML + "colour: red\n", YAML.replace("column: surveyed", "column: name"), YAML + "schema_version: 2\n", YAML.replace("name: name", "name: _name")):
        with pytest.raises(ConfigError):
            from_yaml(bad)


def test_alter_only_adds_at_the_end():
    cfg = from_yaml(YAML)
    more = from_yaml(YAML.replace("ignored_columns", "  - {name: country, type: string}\nignored_columns"))
    assert altered(cfg, more).schema_version == 2
    for bad in (YAML.replace("name: draught, type: double", "name: draught, type: string"), YAML.replace("business_key: hull_no", "business_key: name"), YAML.replace("  - {name: tonnage, type: 'decimal(18,4)'}\n", "")):
        with pytest.raises(ConfigError):
            altered(cfg, from_yaml(bad))


@pytest.mark.parametrize(
    "kind,good,bad",
    [
        ("long", {"5": 5, " 7 ": 7, "": None, "5.0": 5, "9223372036854775807": 9223372036854775807}, ["1.5", "x", "9223372036854775808"]),
        ("tinyint", {"127": 127}, ["128", "-129"]),
        ("double", {"1e3": 1000.0, "": None}, ["one"]),
        ("boolean", {"Yes": True, "0": False, "n": False, "TRUE": True}, ["t", "2"]),
        ("decimal(10,2)", {"1.20": "1.20", "1.2300": "1.23", "7": "7.00"}, ["1.239", "x"]),
        ("date", {"2024-02-29": "2024-02-29", "1": "1970-01-02"}, ["2023-02-29", "soon"]),
        ("timestamp", {"2024-01-01T00:00:00Z": "2024-01-01 00:00:00", "2024-01-01T02:00:00+02:00": "2024-01-01 00:00:00", "2024-01-01": "2024-01-01 00:00:00", "1704067200000000": "2024-01-01 00:00:00"}, ["yesterday", "2024-13-01T00:00:00Z"]),
        ("bytes", {"aGk=": bytearray(b"hi")}, ["?"]),
        ("string", {"": "", "x": "x"}, []),
    ],
)
def test_coercion(spark, kind, good, bad):
    t = parse_type(kind)
    value, refused = coerce(F.col("raw"), t)
    shown = value.cast("string") if isinstance(t, T.DecimalType | T.DateType | T.TimestampType) else value
    rows = spark.createDataFrame([(x,) for x in [*good, *bad, None]], "raw string").select("raw", shown.alias("v"), refused.alias("bad")).collect()
    for r in rows:
        if r.raw is None:
            assert r.v is None and not r.bad
        elif r.raw in good:
            assert (r.v, r.bad) == (good[r.raw], False), r
        else:
            assert r.bad, r


def test_nested_coercion_and_maps(spark):
    t = parse_type("map<string,long>")
    value, bad = coerce(F.col("raw"), t)
    df = spark.createDataFrame([('{"a":1,"b":2}', '{"b":2,"a":1}'), ("nonsense", "{}")], "raw string, other string")
    got = df.select(bad.alias("bad"), comparable(value, t).eqNullSafe(comparable(F.from_json("other", t), t)).alias("same")).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False)]


def test_gates(spark):
    df = spark.createDataFrame([("5", 5.0), ("ab", None), (None, 2000.0)], "s string, d double")
    string, double = T.StringType(), T.DoubleType()
    checks = {
        "a": passes(Gate("s", "matches [0-9]"), F.col("s"), string), "b": passes(Gate("s", "in ('5', x)"), F.col("s"), string), "c": passes(Gate("s", "between 1 and 9"), F.col("s"), string),
        "d": passes(Gate("d", "between 0 and 1000"), F.col("d"), double), "e": passes(Gate("s", "not null"), F.col("s"), string),
    }
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in checks.items()]).collect()] == [(True, True, True, True, True), (False, False, False, True, True), (True, True, True, False, False)]
    for bad in ("between 9 and 1", "matches [", "in 5"):
        with pytest.raises(ConfigError):
            Gate("s", bad).parsed  # noqa: B018


def test_run_ids_rise():
    ids = RunIds(3, clock=lambda: 1_800_000_000.0)
    own = [ids.next() for _ in range(10_000)]
    assert own == sorted(set(own)) and all(0 < x < 1 << 63 for x in own) and parts(own[0])[1] == 3
