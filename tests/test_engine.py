"""Whole transactions: the literal cases of the fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.cli import load, main
from palimpsest.operators.publish import Publisher, consolidate
from palimpsest.operators.stage import from_frame, from_raw
from palimpsest.plans import archive
from palimpsest.plans.config import ConfigError, Gate, TableConfig
from palimpsest.plans.store import Batch, Engine, EngineError, Options
from palimpsest.sources import readers
from palimpsest.streaming.feed import apply_stream, change_feed, change_stream

CUSTOMER = TableConfig(
    "customer", ("customer_id",), (("customer_id", "string"), ("name", "string"), ("risk_score", "double"), ("segment", "string"), ("exposure", "decimal(18,4)"), ("updated_at", "timestamp")),
    ignored_columns=("updated_at",), valid_time_mode="source_column", valid_time_column="updated_at",
    gates=(Gate("customer_id", "not_null"), Gate("risk_score", "between 0 and 1000"), Gate("segment", "in (RETAIL, SME, CORP, PRIVATE)")),
)
PARTIAL = TableConfig("partial", ("id",), (("id", "string"), ("name", "string"), ("seg", "string"), ("risk", "double"), ("eff", "timestamp")), valid_time_mode="source_column", valid_time_column="eff", absent_columns="carry_forward", ignored_columns=("eff",))


@pytest.fixture
def engine(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db"), Options(buckets=2)) as e:
        yield e


def put(e, table, load_id, records, **how):
    return load(e, readers.Input({table: readers.from_records(e.spark, records)}), None, load_id, how.get("snapshot", False), how.get("at"))["tables"][table]


def c(id_, name, risk, at, segment="RETAIL", **more):
    return {"customer_id": id_, "name": name, "risk_score": risk, "segment": segment, "exposure": "1.5", "updated_at": at} | more


def numbers(t, *names):
    return tuple(t[n] for n in names)


def test_walk_through(engine, tmp_path):
    e = engine
    e.create_table(CUSTOMER)
    with pytest.raises(EngineError):
        e.create_table(CUSTOMER)
    with pytest.raises(EngineError, match="open for writing"):
        Engine(e.spark, e.files.root)
    first = [c("C1", "Alice", 120.5, "2026-07-01T00:00:00Z"), c("C2", "Bob", 80, "2026-07-01T00:00:00Z"), c("C3", "Cy", 50, "2026-07-02T00:00:00Z"), {"customer_id": "C2", "updated_at": "2026-07-03T00:00:00Z", "_op": "delete"}]
    assert numbers(put(e, "customer", "L1", first), "rows_in", "inserts", "deletes") == (4, 3, 1)
    assert {r.customer_id for r in e.scan_current("customer").collect()} == {"C1", "C3"}
    (tmp_path / "x.csv").write_text('customer_id,name,risk_score,segment,exposure,updated_at,_op\nC1,"Alice ""A"", B",120.5,RETAIL,1.5,2026-07-04T00:00:00Z,\nC4,Dan,10,SME,2,2026-07-04T00:00:00Z,upsert\nC3,,,,,2026-07-05T00:00:00Z,delete\n')
    t = load(e, readers.read(e.spark, str(tmp_path / "x.csv")), "customer", "L2", False, None)["tables"]["customer"]
    assert numbers(t, "inserts", "updates", "deletes") == (1, 1, 1)
    (tmp_path / "same.csv").write_text((tmp_path / "x.csv").read_text())
    assert load(e, readers.read(e.spark, str(tmp_path / "same.csv")), "customer", "L2", False, None)["tables"]["customer"] == t
    (tmp_path / "e.json").write_text(json.dumps({"table": "customer", "load_id": "L3", "effective_at": "2026-07-10T00:00:00Z", "defaults": {"segment": "RETAIL"}, "source": "desk", "records": [{"customer_id": "C1", "name": 'Alice "A", B', "risk_score": 140, "exposure": "1.5"}]}))
    one = load(e, readers.read(e.spark, str(tmp_path / "e.json")), None, None, False, None)
    again = load(e, readers.read(e.spark, str(tmp_path / "e.json")), None, None, False, None)
    assert one["tables"]["customer"]["updates"] == 1 and again["txn_id"] == one["txn_id"] and one["metadata"] == {"source": "desk"}
    r = e.get_as_of("customer", "2026-07-02", customer_id="C1")
    assert (r["name"], r["risk_score"], str(r["_valid_to"])) == ("Alice", 120.5, "2026-07-04 00:00:00")
    assert len(e.get_history("customer", customer_id="C1")) == 5
    bad = put(e, "customer", "L4", [c("C9", "Z", 1, "2026-07-11T00:00:00Z", segment="UNKNOWN")])
    assert bad["rejects"] == 1 and "segment" in bad["errors"][0]["reason"]
    v = e.verify()["tables"]["customer"]
    assert (v["version_records"], v["entities"], v["current_rows"]) == (11, 4, 2)
    with pytest.raises(EngineError, match="DIFFERENT content"):
        put(e, "customer", "L1", [c("C7", "Q", 1, "2026-07-11T00:00:00Z")])
    assert e.manifest("L2")["tables"]["customer"]["inserts"] == 1 and e.manifest("none") is None and len(e.manifests("customer", 2)) == 2
    before = e.verify()
    e.compact("customer")
    assert e.verify()["tables"] == before["tables"] and len(e.get_history("customer", customer_id="C1")) == 5
    assert e.get_as_of("customer", "2026-07-05", e.commits()[1]["tx_time"], customer_id="C1")["name"] == "Alice"
    assert put(e, "customer", "L5", [c("C4", "Dan", 11, "2026-07-12T00:00:00Z", segment="SME")])["updates"] == 1
    assert e.verify()["tables"]["customer"]["version_records"] == 13
    e.close()
    with Engine(e.spark, e.files.root) as again:  # what a compaction wrote is not swept
        assert again.verify()["tables"]["customer"]["version_records"] == 13


def test_lifecycle(engine):
    e = engine
    e.create_table(CUSTOMER)
    put(e, "customer", "1", [c("A", "a", 1, "2024-03-01T00:00:00Z")])
    tx1 = e.commits()[-1]["tx_time"]
    assert numbers(put(e, "customer", "2", [c("A", "early", 1, "2024-01-01T00:00:00Z")]), "inserts", "late_splits") == (1, 1)
    assert e.get_as_of("customer", "2024-02-01", customer_id="A")["name"] == "early"
    assert e.get_as_of("customer", "2024-02-01", tx1, customer_id="A") is None
    assert put(e, "customer", "3", [c("A", "a", 1, "2024-04-01T00:00:00Z")])["no_ops"] == 1
    assert put(e, "customer", "4", [{"customer_id": "A", "updated_at": "2024-05-01", "_op": "d"}])["deletes"] == 1
    assert e.get_current("customer", customer_id="A") is None
    assert put(e, "customer", "5", [c("A", "back", 1, "2024-06-01T00:00:00Z"), c("A", "last", 1, "2024-06-01T00:00:00Z")])["inserts"] == 1
    assert (e.get_current("customer", customer_id="A")["name"], e.get_current("customer", customer_id="A")["_op"]) == ("last", "INSERT")
    with pytest.raises(ConfigError):
        e.get_current("customer", nobody=1)
    with pytest.raises(Exception, match="unknown _op"):
        put(e, "customer", "6", [{"customer_id": "A", "_op": "explode"}])
    grown = TableConfig.from_dict(CUSTOMER.to_dict() | {"columns": [*CUSTOMER.to_dict()["columns"], ["country", "string"]]})
    e.alter_table(grown)
    assert e.config("customer").schema_version == 2 and e.get_current("customer", customer_id="A")["country"] is None
    assert put(e, "customer", "7", [c("A", "last", 1, "2024-07-01T00:00:00Z", country="CH")])["updates"] == 1


def test_partial_rows(engine):
    e = engine
    e.create_table(PARTIAL)
    put(e, "partial", "1", [{"id": "A", "name": "n", "seg": "s", "risk": 250, "eff": "2024-01-01"}])
    assert put(e, "partial", "2", [{"id": "A", "risk": 260, "eff": "2024-01-02"}])["updates"] == 1
    put(e, "partial", "3", [{"id": "A", "seg": "t", "eff": "2024-01-03"}])
    r = e.get_current("partial", id="A")
    assert (r["name"], r["seg"], r["risk"]) == ("n", "t", 260.0)
    assert put(e, "partial", "4", [{"id": "A", "seg": "t", "eff": "2024-01-04"}])["no_ops"] == 1
    put(e, "partial", "5", [{"id": "A", "seg": None, "eff": "2024-01-05"}])
    assert e.get_current("partial", id="A")["seg"] is None and len({h["_valid_from"] for h in e.get_history("partial", id="A")}) == 4


def test_quarantine_and_reapply(engine):
    e = engine
    base = dict(table="q", business_key=("id",), columns=(("id", "string"), ("score", "long")), on_row_error="quarantine")
    e.create_table(TableConfig(**base, gates=(Gate("score", "between 0 and 100"),)))
    assert numbers(put(e, "q", "1", [{"id": "a", "score": 50}, {"id": "b", "score": 5000}, {"id": "c", "score": "many"}]), "inserts", "quarantined") == (1, 2)
    assert e.quarantine("q").count() == 2
    e.alter_table(TableConfig(**base, gates=(Gate("score", "between 0 and 10000"),)))
    assert numbers(e.reapply("q", "2")["tables"]["q"], "inserts", "quarantined") == (1, 0)
    left = e.quarantine("q").collect()
    assert [r.raw["id"] for r in left] == ["c"] and "score" in left[0].reason


def test_transactions_are_whole(engine):
    e = engine
    e.create_table(CUSTOMER)
    e.create_table(TableConfig("adjustment", ("adj_id",), (("adj_id", "string"), ("amount", "decimal(18,2)")), on_row_error="fail_batch", gates=(Gate("amount", "not_null"),)))
    both = {"customer": [c("C9", "N", 1, "2026-01-01")], "adjustment": [{"adj_id": "A1"}]}
    with pytest.raises(EngineError):
        load(e, readers.parse_document(e.spark, json.dumps(both)), None, "m", False, None)
    assert e.manifest("m") is None and e.scan_current("customer").count() == 0
    both["adjustment"][0]["amount"] = "1.50"
    out = load(e, readers.parse_document(e.spark, json.dumps(both)), None, "m", False, None)
    assert set(out["tables"]) == {"customer", "adjustment"}
    # What no commit names is swept when the next writer opens.
    e.spark.range(3).write.parquet(e.files.at("tables/customer/versions/txn=00000000000000000099"))
    e.close()
    with Engine(e.spark, e.files.root) as again:
        assert not again.files.exists("tables/customer/versions/txn=00000000000000000099") and again.scan_current("customer").count() == 1
    for bad in ("", " ", "x" * 513):
        with pytest.raises(ConfigError):
            e._check_load_id(bad)
    numeric = Engine(e.spark, e.files.root, Options(numeric_load_ids=True), read_only=True)
    for bad in ("abc", "run-1", "-5", "0", "1.5", "99999999999999999999"):
        with pytest.raises(ConfigError):
            numeric._check_load_id(bad)
    numeric._check_load_id("42")


def test_snapshot_and_intervals(engine):
    e = engine
    e.create_table(TableConfig("imp", ("id",), (("id", "string"), ("v", "string"))))
    k = lambda i, v, a, b=None: {"id": i, "v": v, "__START_AT": a, "__END_AT": b}
    rows = [k("K1", "old", "2024-01-01", "2024-02-01"), k("K1", "new", "2024-02-01"), k("K2", "x", "2024-01-01", "2024-02-01"), k("K3", "a", "2024-01-01", "2024-02-01"), k("K3", "b", "2024-05-01")]
    put(e, "imp", "1", rows)
    assert e.get_current("imp", id="K1")["v"] == "new" and e.get_current("imp", id="K2") is None
    assert e.get_as_of("imp", "2024-03-01", id="K3") is None and e.get_current("imp", id="K3")["_op"] == "INSERT"
    again = put(e, "imp", "2", rows)
    assert numbers(again, "inserts", "updates", "deletes") == (0, 0, 0) and again["no_ops"] > 0
    with pytest.raises(Exception, match="ends before"):
        put(e, "imp", "3", [k("K9", "x", "2024-02-01", "2024-01-01")])
    assert numbers(put(e, "imp", "4", [{"id": "K1", "v": "new"}], snapshot=True), "deletes", "no_ops") == (1, 1)
    assert [r.id for r in e.scan_current("imp").collect()] == ["K1"]
    assert numbers(put(e, "imp", "5", [{"id": "K1", "v": "new"}], snapshot=True), "inserts", "updates", "deletes") == (0, 0, 0)


def test_composite_keys(engine):
    e = engine
    e.create_table(TableConfig("position", ("account_id", "symbol"), (("account_id", "string"), ("symbol", "string"), ("qty", "long"), ("desk", "string"))))
    p = lambda a, s, q: {"account_id": a, "symbol": s, "qty": q, "desk": "d"}
    assert put(e, "position", "1", [p("A", "X", 1), p("A", "Y", 1), p("B", "X", 1)])["inserts"] == 3
    assert put(e, "position", "2", [p("A", "X", 2), p("A", "Y", 1)])["updates"] == 1
    assert numbers(put(e, "position", "3", [p(None, "X", 2), p("A", None, 1), p("C", "X", 1)]), "rejects", "inserts") == (2, 1)


def test_publish(engine, tmp_path):
    e = engine
    base = dict(business_key=("id",), columns=(("id", "string"), ("v", "string"), ("ts", "timestamp")), ignored_columns=("ts",), valid_time_mode="source_column", valid_time_column="ts")
    e.create_table(TableConfig("dim", column_style="databricks", **base))
    r = lambda i, v, d, **m: {"id": i, "v": v, "ts": d} | m
    put(e, "dim", "1", [r("A", "1", "2024-01-01"), r("B", "1", "2024-01-01")])
    p = Publisher(e, "dim", str(tmp_path / "out"))
    p.publish()
    put(e, "dim", "2", [r("A", "2", "2024-02-01"), r("B", None, "2024-02-01", _op="delete")])
    p.publish()
    assert p.publish() is None and p.read().count() == 5 and "_op" not in p.read().columns and [x.id for x in p.current().collect()] == ["A"]
    # A deletion at the instant of the version: the published row must not stay open.
    put(e, "dim", "3", [r("A", None, "2024-02-01", _op="delete")])
    p.publish()
    assert p.current().count() == 0
    done = p.finalize()
    assert (done["log_rows"], done["current_rows"]) == (6, 0) and p.files.names("data") == ["final=0000000004"]
    e.spark.range(1).write.parquet(str(tmp_path / "out/data/part=0000000099"))
    q = Publisher(e, "dim", str(tmp_path / "out"))
    assert len(q.files.names("data")) == 2  # who only reads deletes nothing
    assert q.publish() is None and q.files.names("data") == ["final=0000000004"]
    contract = p.files.json("_contract.json")
    assert contract["start"] == "__START_AT"
    p.read().createOrReplaceTempView("dim")
    names = sorted(consolidate(p.read(), p.cfg).columns)
    assert sorted(map(str, e.spark.sql(contract["view"]).select(*names).collect())) == sorted(map(str, consolidate(p.read(), p.cfg).select(*names).collect()))
    e.create_table(TableConfig("adj", ("adj_id",), (("adj_id", "string"), ("region", "string"), ("year", "int"), ("amount", "decimal(18,2)"), ("effective", "timestamp")), ignored_columns=("effective",), valid_time_mode="source_column", valid_time_column="effective", partition_by=("region", "year")))
    a = lambda i, g, y, n: {"adj_id": i, "region": g, "year": y, "amount": n, "effective": "2024-01-01"}
    put(e, "adj", "4", [a("1", "EU", 2024, 1), a("2", "US", 2024, 1), a("3", "EU", 2025, 1), a("4", None, 2024, 1)])
    q = Publisher(e, "adj", str(tmp_path / "adj"), "json")
    entry = q.publish()
    assert entry["partitions"] == 4 and q.partitions().count() == 4 and any("__HIVE_DEFAULT_PARTITION__" in n for n, _ in q.files.files("data"))
    put(e, "adj", "5", [a("1", "EU", 2024, 2)])
    q.publish()
    assert q.read().count() == 5 and q.current().count() == 4
    q.current().createOrReplaceTempView("adj_current")
    q.read().createOrReplaceTempView("adj")
    assert e.spark.sql(q.files.json("_contract.json")["view"]).where("_is_current").count() == 4


def test_archive_and_restore(engine, tmp_path):
    e = engine
    e.create_table(CUSTOMER)
    for n in range(3):
        put(e, "customer", str(n), [c("A", f"n{n}", 1, f"2024-0{n + 1}-01")])
    assert archive.ship(e, str(tmp_path / "arc"))["commits"] == 4 and archive.ship(e, str(tmp_path / "arc"))["commits"] == 0
    archive.restore(e.spark, str(tmp_path / "arc"), str(tmp_path / "whole"))
    archive.restore(e.spark, str(tmp_path / "arc"), str(tmp_path / "early"), 3)
    whole, early = (Engine(e.spark, str(tmp_path / n), read_only=True) for n in ("whole", "early"))
    assert whole.verify() == e.verify() and early.get_current("customer", customer_id="A")["name"] == "n1"
    victim = next(p for p in (tmp_path / "arc/tables").rglob("*.parquet"))
    victim.write_bytes(b"PAR1" + victim.read_bytes()[4:-4] + b"PARX")
    for crc in (tmp_path / "arc/tables").rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(EngineError, match="damaged"):
        archive.restore(e.spark, str(tmp_path / "arc"), str(tmp_path / "third"))


def test_streams(engine, spark, tmp_path):
    e = engine
    e.create_table(CUSTOMER)
    src = tmp_path / "in"
    spark.createDataFrame([("S1", "a", 1.0, "RETAIL", "2024-01-01"), ("S1", "b", 1.0, "RETAIL", "2024-02-01")], "customer_id string, name string, risk_score double, segment string, t string").write.parquet(str(src))
    stream = spark.readStream.schema("customer_id string, name string, risk_score double, segment string, t string").parquet(str(src))
    to_rows = lambda df, cfg: from_frame(df.withColumn("updated_at", F.col("t").cast("timestamp")), cfg)
    for _ in range(2):
        q = apply_stream(e, "customer", stream, to_rows, str(tmp_path / "cp"), "s")
        q.awaitTermination()
    assert len(e.manifests("customer")) == 1 and e.get_current("customer", customer_id="S1")["name"] == "b"
    e.compact("customer")
    assert change_feed(e, "customer").count() == 2
    q = change_stream(spark, e, "customer").writeStream.format("memory").queryName("feed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert spark.table("feed").count() == 2


def test_command_line(spark, tmp_path, capsys):
    db = str(tmp_path / "db")
    (tmp_path / "t.yaml").write_text("table: t\nbusiness_key: id\nschema: [{name: id, type: string}, {name: v, type: long}]\n")
    (tmp_path / "r.jsonl").write_text('{"id":"a","v":1}\n\n{"id":"b","v":2}\n')
    assert main(["--db", db, "table", "create", str(tmp_path / "t.yaml")], spark) == 0
    assert main(["--db", db, "load", str(tmp_path / "r.jsonl"), "--table", "t", "--load-id", "1"], spark) == 0
    assert main(["--db", db, "get", "t", "id=a"], spark) == 0
    assert '"v": 1' in capsys.readouterr().out
    assert main(["--db", db, "get", "t", "id=z"], spark) == 3
    assert main(["--db", db, "get", "t", "oops"], spark) == 2
    assert main(["--db", db, "load", str(tmp_path / "r.jsonl"), "--table", "t", "--load-id", "2"], spark) == 1
    assert main(["bogus"], spark) == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"a","n":null},{"id":"b"}]')
    rows = {r.raw["id"]: r.raw for r in readers.read(spark, str(tmp_path / "a.json")).rows[None].collect()}
    assert "n" in rows["a"] and rows["a"]["n"] is None and "n" not in rows["b"]
    (tmp_path / "bad.jsonl").write_text('{"id":1}\nnot json\n')
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read(spark, str(tmp_path / "bad.jsonl")).rows[None].collect()
    (tmp_path / "ragged.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read(spark, str(tmp_path / "ragged.csv")).rows[None].collect()
    (tmp_path / "m.csv").write_text('a,b\n"x, y","line\nbreak ""q"""\nz,\n')
    got = {r.raw["a"]: r.raw["b"] for r in readers.read(spark, str(tmp_path / "m.csv")).rows[None].collect()}
    assert got == {"x, y": 'line\nbreak "q"', "z": None}
    assert readers.read_string(spark, 'a,b\n1,"q ""x"""\n', "csv").rows[None].first().raw == {"a": "1", "b": 'q "x"'}
    for bad in ("5", "{}", '{"t": 5}', "[1]", "{"):
        with pytest.raises(ConfigError):
            readers.parse_document(spark, bad)
    with pytest.raises(ConfigError):
        readers.format_of("x.parquet")
    with pytest.raises(ConfigError):
        readers.resolve_load_id("a", "b")
    assert readers.parse_key(["a=b=c"]) == {"a": "b=c"}


def files_of(tmp_path, **texts):
    out = []
    for name, text in texts.items():
        path = tmp_path / name.replace("_", ".")
        path.write_text(text)
        out.append(str(path))
    return out


@pytest.mark.parametrize("text", ['[{"id": "1"}, {"id": "2"', '[1, 2, {"id": "3"}]', '[{"id": "1"}, null]', '[{"id": "1"}] trailing', '[{"id": "1"}], [{"id": "2"}]', "[{'id': '1'}]", "", "nothing", '[{"id": "1"},]'])
def test_a_malformed_array_changes_nothing(engine, tmp_path, text):
    e = engine
    e.create_table(TableConfig("t", ("id",), (("id", "string"), ("v", "string"))))
    put(e, "t", "1", [{"id": str(i), "v": "a"} for i in range(5)])
    (path,) = files_of(tmp_path, x_json=text)
    with pytest.raises(Exception):  # noqa: B017  a ConfigError here, or Spark's error on an executor
        load(e, readers.read(e.spark, path), "t", "2", True, None)
    assert e.scan_current("t").count() == 5 and len(e.commits()) == 2 and e.files.names("staging") == []


def test_a_folder_of_arrays_is_read_whole(engine, tmp_path):
    e = engine
    e.create_table(TableConfig("t", ("id",), (("id", "string"), ("v", "string"))))
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.json").write_text(json.dumps([{"id": f"{n}-{i}", "v": "x", "deep": {"a": [1]}} for i in range(4)]))
    assert load(e, readers.read(e.spark, str(folder), "json"), "t", "1", False, None)["tables"]["t"]["inserts"] == 12
    (folder / "9.json").write_text('{"table": "t", "records": []}')
    with pytest.raises(ConfigError):
        readers.read(e.spark, str(folder), "json")


def test_an_array_is_read_in_splits(spark, tmp_path):
    """Elements with brackets, quotes and escapes in strings, nested ones and ones longer than a split keep their place, and no task reads the file whole."""
    rows = [{"id": f"{i}", "text": 'a}],{["\\' * (i % 5), "deep": {"a": [1, {"b": "}"}]}} for i in range(60)]
    rows[30]["text"] = "x}" * 2000
    (path,) = files_of(tmp_path, big_json=" \n" + json.dumps(rows, indent=1) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        df = readers.read(spark, path).rows[None]
        assert df.rdd.getNumPartitions() > 5
        found = sorted(df.select("_ord.row", "raw").collect())
        for bad in ('[{"id": "1"}]}', '[{"id": "1"}],', '[{"id": "1"}}', '[{"id": "1"} {"id": "2"}]', '[[{"id": "1"}]]'):
            with pytest.raises(Exception):  # noqa: B017
                readers.read(spark, files_of(tmp_path, bad_json=bad)[0]).rows[None].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.row for r in found] == list(range(60))
    assert [(r.raw["id"], r.raw["text"], json.loads(r.raw["deep"])) for r in found] == [(x["id"], x["text"], x["deep"]) for x in rows]


def test_a_batch_is_shuffled_once_to_be_decided_and_written(spark):
    from palimpsest.operators.decide import decide
    from palimpsest.plans.queries import ORDERS, _none, _orders

    pending, key = _orders(spark, "/root/testdata/sf0.001"), F.col("o_custkey")
    plain = decide(_none(ORDERS, spark), pending, ORDERS).changes
    dealt = decide(_none(ORDERS, spark), pending, ORDERS, {"_bucket": F.pmod(key, F.lit(4)).cast("int"), "_share": F.pmod(key, F.lit(7))}).changes
    assert dealt.sortWithinPartitions("_bucket", "o_custkey", "_valid_from")._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    assert sorted(map(str, dealt.drop("_bucket").collect())) == sorted(map(str, plain.collect()))
    assert dealt.where("_bucket <> pmod(o_custkey, 4)").count() == 0


def test_current_rows_of_a_publication_are_those_of_its_whole_log(engine, tmp_path):
    e = engine
    e.create_table(TableConfig("t", ("id",), (("id", "string"), ("v", "string"))))
    put(e, "t", "1", [{"id": str(i), "v": "a"} for i in range(9)], at="2024-01-01T00:00:00Z")
    put(e, "t", "2", [{"id": str(i), "v": "b"} for i in range(5)], at="2023-01-01T00:00:00Z")
    put(e, "t", "3", [{"id": str(i), "_op": "delete"} if i % 2 else {"id": str(i), "v": "c"} for i in range(4, 9)], at="2025-01-01T00:00:00Z")
    p = Publisher(e, "t", str(tmp_path / "out"))
    p.publish()
    told = p.finalize()
    want = consolidate(p.read(), p.cfg).where("_is_current")
    assert p.current().columns == want.columns and "Window" not in p.current()._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(p.current().collect()) == sorted(want.collect())
    assert told["current_rows"] == want.count() == 7 and told["log_rows"] == p.read().count()


def test_point_reads_open_one_bucket(engine):
    e = engine
    e.create_table(TableConfig("t", ("id",), (("id", "long"), ("v", "string"))))
    put(e, "t", "1", [{"id": str(i), "v": f"v{i}"} for i in range(40)])
    own, _ = e._keyed("t", {"id": 7})
    assert "(_bucket" in own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    assert [e.get_current("t", id=i)["v"] for i in (0, 7, "39")] == ["v0", "v7", "v39"] and e.get_current("t", id=41) is None
    e.compact("t", 3)
    assert [e.get_current("t", id=i)["v"] for i in range(5)] == [f"v{i}" for i in range(5)] and len(e.get_history("t", id=6)) == 1


def test_interval_columns_stay_beside_what_is_coerced(spark):
    cfg = TableConfig("t", ("id",), (("id", "long"), ("v", "string")))
    raw = spark.sql("select map('id', '1', 'v', 'x') raw, false _delete, cast(null as timestamp) _override, 1L _ord, timestamp'2024-01-01' _start, timestamp'2024-01-02' _end")
    r = from_raw(raw, cfg, "_start", "_end").first()
    assert (r.id, r.v, r._start.day, r._end.day) == (1, "x", 1, 2)


def test_the_same_file_split_otherwise_is_the_same_content(engine, tmp_path):
    e, conf = engine, engine.spark.conf
    e.create_table(TableConfig("t", ("id",), (("id", "string"), ("v", "string"))))
    rows = [json.dumps({"id": f"k{i % 400}", "v": f"{i}"}) for i in range(3000)]
    (path,) = files_of(tmp_path, x_jsonl="\n".join([*rows[:7], "", *rows[7:]]))
    before = conf.get("spark.sql.files.maxPartitionBytes")
    try:
        conf.set("spark.sql.files.maxPartitionBytes", "4k")
        assert readers.read_jsonl(e.spark, path).rdd.getNumPartitions() > 5
        first = load(e, readers.read(e.spark, path), "t", "1", False, None)
        conf.set("spark.sql.files.maxPartitionBytes", "64m")
        assert load(e, readers.read(e.spark, path), "t", "1", False, None) == first and first["tables"]["t"]["inserts"] == 400
    finally:
        conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["id"]: r["v"] for r in e.scan_current("t").collect()} == {f"k{i}": str(max(x for x in range(3000) if x % 400 == i)) for i in range(400)}
    swapped = "\n".join([rows[400], *rows[1:400], rows[0], *rows[401:]])
    with pytest.raises(EngineError, match="DIFFERENT"):
        load(e, readers.read(e.spark, *files_of(tmp_path, y_jsonl=swapped)), "t", "1", False, None)


def test_a_bad_line_is_named(engine, tmp_path):
    for bad in ("{'id': 1}", '{"id": "1"', "[1]", '{"id": "1"} x', '"text"'):
        (path,) = files_of(tmp_path, x_jsonl='{"id": "0"}\n\n' + bad + "\n")
        with pytest.raises(Exception, match="line 3"):
            readers.read_jsonl(engine.spark, path).collect()


def test_buckets_belong_to_the_database(spark, tmp_path):
    cfg = TableConfig("t", ("id",), (("id", "long"), ("v", "string")))
    rows = lambda v: from_frame(spark.range(40).select("id", F.lit(v).alias("v")), cfg, F.col("id"))
    with Engine(spark, str(tmp_path / "db"), Options(buckets=8)) as e:
        e.create_table(cfg)
        e.apply("1", [Batch("t", rows("a"))])
    with Engine(spark, str(tmp_path / "db")) as e:
        one = from_frame(spark.range(3, 4).select("id", F.lit("a").alias("v")), cfg, F.col("id"))
        assert numbers(e.apply("2", [Batch("t", one)])["tables"]["t"], "no_ops", "inserts") == (1, 0)
        assert e.compact("t", 5)["buckets"] == {"t": 5}
        assert numbers(e.apply("3", [Batch("t", rows("a"))])["tables"]["t"], "no_ops", "inserts") == (40, 0) and e.scan_current("t").count() == 40
        assert len([n for n, _ in e.files.files("tables") if n.endswith(".parquet")]) > 8


def test_a_lock_goes_with_its_holder(spark, tmp_path):
    import subprocess

    path = str(tmp_path / "db")
    e = Engine(spark, path)
    with pytest.raises(EngineError, match="elsewhere"):
        Engine(spark, path)
    ended = subprocess.Popen(["true"])
    ended.wait()
    dead = ended.pid
    e.files.replace(json.dumps(json.loads(e.token) | {"pid": dead}), "LOCK")  # as a killed process leaves it
    with Engine(spark, path) as after:
        after.create_table(TableConfig("t", ("id",), (("id", "long"),)))
        with pytest.raises(EngineError, match="lock"):
            e.create_table(TableConfig("u", ("id",), (("id", "long"),)))
    other = Engine(spark, path)
    other.files.replace(json.dumps(json.loads(other.token) | {"host": "another", "pid": 1}), "LOCK")
    with pytest.raises(EngineError):
        Engine(spark, path)
    other.files.fs.setTimes(other.files._path(other.files.at("LOCK")), 1000, -1)  # nobody has touched it for long
    Engine(spark, path).close()
    assert main(["--db", path, "unlock"], spark) == 0 and not other.files.exists("LOCK")


def test_a_long_log_opens_with_few_reads(spark, tmp_path, monkeypatch):
    from palimpsest.plans import store
    from palimpsest.plans.files import Files

    monkeypatch.setattr(store, "CHECKPOINT", 10)
    with Engine(spark, str(tmp_path / "db")) as e:
        for n in range(57):
            e.create_table(TableConfig(f"t{n}", ("id",), (("id", "long"),)))
    reads, real = [], Files.read
    monkeypatch.setattr(Files, "read", lambda self, *parts: reads.append(parts) or real(self, *parts))
    e = Engine(spark, str(tmp_path / "db"), read_only=True)
    assert len(e.commits()) == 57 and len(reads) == 8 and len(e.commits()) == 57 and len(reads) == 8
    e.files.replace(real(e.files, "_commit_log", f"{57:020d}.json").replace('"long"', '"int"'), "_commit_log", f"{57:020d}.json")
    with pytest.raises(EngineError, match="damaged"):
        Engine(spark, str(tmp_path / "db"), read_only=True).commits()


def test_only_one_of_many_creates_a_file(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from palimpsest.plans.files import Files

    files = Files(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        for n in range(10):
            assert sum(pool.map(lambda k, n=n: files.create(str(k), f"f{n}"), range(8))) == 1
    files.replace("new", "f0")
    assert files.read("f0") == "new" and [n for n in files.names() if n.startswith(".") and not n.endswith(".crc")] == []


def test_partitions_are_counted_whatever_their_number(engine, tmp_path):
    e = engine
    cfg = TableConfig("p", ("id",), (("id", "long"), ("part", "int"), ("at", "timestamp")), ignored_columns=("at",), valid_time_mode="source_column", valid_time_column="at", partition_by=("part",))
    e.create_table(cfg)
    rows = e.spark.range(10_200).select("id", F.col("id").cast("int").alias("part"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    e.apply("1", [Batch("p", from_frame(rows, cfg, F.col("id")))])
    p = Publisher(e, "p", str(tmp_path / "p"))
    entry = p.publish()
    assert (entry["partitions"], entry["rows"]) == (10_200, 10_200) and p.partitions().count() == 10_200


def test_as_of_flags_and_prefixes(engine):
    e = engine
    e.create_table(TableConfig("pos", ("a", "b"), (("a", "string"), ("b", "string"), ("q", "long"), ("eff", "timestamp")), valid_time_mode="source_column", valid_time_column="eff"))
    p = lambda a, b, q, t: {"a": a, "b": b, "q": q, "eff": t}
    put(e, "pos", "1", [p("x", "1", 1, "2024-01-01"), p("x", "2", 1, "2024-01-01"), p("y", "1", 1, "2024-01-01"), p("x", "1", 2, "2024-02-01")])
    tx = e.commits()[-1]["tx_time"]
    flag = lambda t, *more: e.get_as_of("pos", t, *more, a="x", b="1")["_is_current"]
    assert (flag("2024-01-15"), flag("2024-03-01"), flag("2024-03-01", tx)) == (False, True, False)
    assert [(r.a, r.b, r.q) for r in e.scan_prefix("pos", a="x").collect()] == [("x", "1", 2), ("x", "2", 1)]
    assert [r.q for r in e.scan_prefix("pos", "2024-01-15", a="x").collect()] == [1, 1]
    with pytest.raises(ConfigError):
        e.scan_prefix("pos", b="1")


def test_content_tells_nulls_and_neighbours_apart(spark):
    """A row's marks differ if a value moves to the next column, is null, or stands elsewhere in the input; not if another file holds it."""
    rows = [("x", None, None, "a", 1), (None, "x", None, "a", 1), (None, None, None, "a", 1), ("", None, None, "a", 1), ("x", None, None, "a", 2), ("x", None, ["x", None], "a", 1), ("x", None, [None, "x"], "a", 1), ("x", None, None, "b", 1)]
    df = spark.createDataFrame(rows, "a string, b string, c array<string>, f string, r long").select("a", "b", "c", F.struct(F.col("f").alias("file"), F.col("r").alias("row")).alias("_ord"))
    marks = [(r["_mark_x"], r["_mark_y"]) for r in Engine._marks(df).collect()]
    assert len(set(marks[:7])) == 7 and marks[7] == marks[0]
