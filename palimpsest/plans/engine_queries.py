"""Queries over the test tables that go through a database: files in, transactions, reads, publication, archives. Each makes a database of its own in the shared folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..cli import load
from ..operators import reads
from ..operators.intervals import from_intervals
from ..operators.publish import Publisher
from ..operators.stage import from_frame, from_raw
from ..sources import readers
from ..streaming.feed import apply_stream, change_feed, change_stream
from . import archive
from .config import ConfigError, Gate, TableConfig, from_yaml
from .files import Files, scratch
from .queries import AS_OF, GATED, LINES, ORDERS, PERIODS, _chain, _plain, _table, _with
from .store import Batch, Engine, EngineError, Options

CUSTOMERS = TableConfig("customers", ("c_custkey",), (("c_custkey", "long"), ("c_name", "string"), ("c_acctbal", "double"), ("c_mktsegment", "string")))
SUPPLIERS = TableConfig("suppliers", ("s_suppkey",), (("s_suppkey", "long"), ("s_name", "string"), ("s_acctbal", "double")))
PLACES = (TableConfig("nation", ("n_nationkey",), (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))), TableConfig("region", ("r_regionkey",), (("r_regionkey", "int"), ("r_name", "string"))))


def _database(spark: SparkSession, *tables: TableConfig) -> Engine:
    path = scratch(spark, "database")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    e = Engine(spark, path, Options(buckets=4))
    for t in tables:
        e.create_table(t)
    return e


def _third(spark: SparkSession, sf_dir: str, n: int, of: int) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    keys = (orders.agg(F.max("o_orderkey")).first()[0] or 0) + 1
    return orders.where(F.floor(F.col("o_orderkey") * of / keys) == n)


def _loaded(spark: SparkSession, sf_dir: str, of: int = 3, cfg: TableConfig = ORDERS, after: Callable[[Engine], object] = lambda e: None) -> Engine:
    """orders in `of` transactions of neighbouring order keys, whose dates overlap; the table's declaration is transaction 1."""
    e = _database(spark, cfg)
    for n in range(of):
        e.apply(f"b{n}", [Batch(cfg.table, from_frame(_third(spark, sf_dir, n, of), cfg, F.col("o_orderkey")))])
        after(e)
    return e


def _rows(log: DataFrame, *more: str) -> DataFrame:
    return _chain(log.withColumn("tx", (F.col("_txn_id") - 1).cast("int")), ORDERS, *more)


def _parts(df: DataFrame) -> DataFrame:
    """df in files whose names go up with the order key."""
    return df.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")


def _raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(_table(spark, sf_dir, "orders")).select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("o_orderdate"))


def _from_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    with _database(spark, ORDERS) as e:
        load(e, readers.read(spark, path, kind), ORDERS.table, "files", False, None, True)
        return _rows(e.scan_current(ORDERS.table))


def engine_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    _raw_orders(spark, sf_dir).select(F.to_json(F.struct("*"))).write.text(path)
    return _from_files(spark, path, "jsonl")


def engine_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    _raw_orders(spark, sf_dir).write.csv(path, header=True, quoteAll=True)
    return _from_files(spark, path, "csv")


def engine_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files that are one array each."""
    path = scratch(spark, "arrays")

    def whole(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        said = lambda lines: pa.RecordBatch.from_arrays([lines], names=["value"])
        yield said(pa.array(["["], pa.string()))
        first = True
        for b in batches:
            lines = b.column(0).cast(pa.string())
            if first and len(lines):
                yield said(lines[:1])
                lines, first = lines[1:], False
            yield said(pc.binary_join_element_wise("", lines, ","))
        yield said(pa.array(["]"], pa.string()))

    _raw_orders(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).mapInArrow(whole, "value string").write.text(path)
    return _from_files(spark, path, "json")


def _places(e: Engine, given: readers.Input) -> DataFrame:
    load(e, given, None, "places", False, None)
    return e.scan_current("nation").join(e.scan_current("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def _records(spark: SparkSession, sf_dir: str, name: str) -> list[dict]:
    return [json.loads(r[0]) for r in _table(spark, sf_dir, name).select(F.to_json(F.struct("*"))).collect()]  # 25 nations, 5 regions


def engine_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object of two tables is one transaction."""
    with _database(spark, *PLACES) as e:
        return _places(e, readers.read_string(spark, json.dumps({t: _records(spark, sf_dir, t) for t in ("nation", "region")}), "json"))


def engine_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope names table, load id, time and defaults."""
    with _database(spark, *PLACES) as e:
        rows = [{k: v for k, v in r.items() if k != "n_regionkey"} for r in _records(spark, sf_dir, "nation")]
        doc = {"table": "nation", "load_id": "one", "effective_at": "2020-01-01T00:00:00Z", "defaults": {"n_regionkey": 7}, "records": rows, "by": "a test"}
        found = load(e, readers.read_string(spark, json.dumps(doc), "json"), None, None, False, None)
        out = e.scan_current("nation").select("n_nationkey", "n_name", "n_regionkey", F.col("_valid_from").alias("valid_from"), F.lit(found["load_id"]).alias("load_id"), F.lit(found["metadata"]["by"]).alias("by"))
        return _plain(out)


def engine_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _loaded(spark, sf_dir) as e:
        return _rows(reads.history(e.log(ORDERS.table), ORDERS).withColumnRenamed("_is_current", "is_current"), "tx", "is_current")


def engine_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _loaded(spark, sf_dir) as e:
        return _rows(e.scan_current(ORDERS.table))


def engine_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As known after each transaction, and now (known_at 0), with the flag of open versions."""
    with _loaded(spark, sf_dir) as e:
        times = [None, *[c["tx_time"] for c in e.commits()[1:]]]
        found = [_rows(e.scan_as_of(ORDERS.table, AS_OF, tx).withColumnRenamed("_is_current", "is_current"), "is_current").withColumn("known_at", F.lit(n)) for n, tx in enumerate(times)]
        return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def engine_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction into other buckets, then a transaction that changes nothing: every belief is as it was."""
    with _loaded(spark, sf_dir) as e:
        e.compact(ORDERS.table, 7)
        e.apply("again", [Batch(ORDERS.table, from_frame(_third(spark, sf_dir, 2, 3), ORDERS, F.col("o_orderkey")))])
        return _rows(e.log(ORDERS.table), "tx")


COUNTS = ("rows_in", "inserts", "updates", "no_ops", "deletes", "late_splits", "rejects", "quarantined")


def engine_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _loaded(spark, sf_dir) as e:
        rows = [(m["load_id"], *[int(m["tables"][ORDERS.table][c]) for c in COUNTS]) for m in e.manifests()]
        return spark.createDataFrame(rows, "load_id string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def engine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each load again, dealt otherwise: the first receipt; with a row less: refused. Nothing of either is applied."""
    out = []
    with _loaded(spark, sf_dir) as e:
        for n in range(3):
            rows = from_frame(_third(spark, sf_dir, n, 3).repartition(5), ORDERS, F.col("o_orderkey"))
            same = e.apply(f"b{n}", [Batch(ORDERS.table, rows)]) == e.manifest(f"b{n}")
            try:
                e.apply(f"b{n}", [Batch(ORDERS.table, rows.where(F.col("_ord") % 100 != 7))])
                refused = False
            except EngineError:
                refused = True
            out.append((f"b{n}", same, refused, len(e.commits()), e.log(ORDERS.table).count()))
    return spark.createDataFrame(out, "load_id string, same boolean, refused boolean, commits bigint, versions bigint")


def engine_multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in one transaction; another whose second table fails leaves both as they were."""
    strict = _with(SUPPLIERS, on_row_error="fail_batch", gates=(Gate("s_suppkey", "not_null"),))
    with _database(spark, CUSTOMERS, strict) as e:
        c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
        both = lambda c, s: [Batch("customers", from_frame(c, CUSTOMERS, F.col("c_custkey"))), Batch("suppliers", from_frame(s, strict, F.col("s_suppkey")))]
        e.apply("1", both(c, s))
        try:
            e.apply("2", both(c.withColumn("c_name", F.lit("gone")), s.withColumn("s_suppkey", F.nullif("s_suppkey", F.lit(3)))))
        except EngineError:
            pass
        one = e.scan_current("customers").select(F.lit("customers").alias("t"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("_txn_id").alias("txn"))
        return one.unionByName(e.scan_current("suppliers").select(F.lit("suppliers").alias("t"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("_txn_id").alias("txn")))


def _gated(spark: SparkSession, sf_dir: str, how: str) -> Engine:
    cfg = _with(GATED, on_row_error=how)
    e = _database(spark, cfg)
    e.apply("1", [Batch("customer", from_frame(_table(spark, sf_dir, "customer"), cfg, F.col("c_custkey")))])
    return e


def engine_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that gates refuse are counted and left out."""
    with _gated(spark, sf_dir, "skip_rows") as e:
        n = e.manifest("1")["tables"]["customer"]
        return e.scan_current("customer").select("c_custkey", F.lit(n["rejects"]).cast("bigint").alias("rejects"), F.lit(n["inserts"]).cast("bigint").alias("inserts"))


def engine_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _gated(spark, sf_dir, "quarantine") as e:
        return e.quarantine("customer").select(F.element_at("raw", "c_custkey").cast("bigint").alias("c_custkey"), "reason")


def engine_reapplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the gates but one are lifted, the diverted rows that pass now are taken; the others stay diverted."""
    with _gated(spark, sf_dir, "quarantine") as e:
        e.alter_table(_with(e.config("customer"), gates=(Gate("c_acctbal", "between 0 and 9000"),)))
        taken = e.reapply("customer", "2")["tables"]["customer"]["inserts"]
        here = e.scan_current("customer").select("c_custkey", F.lit("table").alias("at"))
        return here.unionByName(e.quarantine("customer").select(F.element_at("raw", "c_custkey").cast("bigint").alias("c_custkey"), F.lit("quarantine").alias("at"))).withColumn("taken", F.lit(taken).cast("bigint"))


def engine_late_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = _with(ORDERS, late_policy="quarantine")
    with _loaded(spark, sf_dir, 2, cfg) as e:
        raw = lambda c: F.element_at("raw", c)
        return _plain(e.quarantine(cfg.table).select(raw("o_custkey").cast("bigint").alias("o_custkey"), F.col("_override").alias("valid_from"), raw("o_orderstatus").alias("o_orderstatus"), raw("o_orderpriority").alias("o_orderpriority")))


def engine_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column more: rows from before have null there, and keep their schema's version."""
    small = TableConfig("grown", ("c_custkey",), (("c_custkey", "long"), ("c_name", "string")))
    with _database(spark, small) as e:
        c = _table(spark, sf_dir, "customer")
        e.apply("1", [Batch("grown", from_frame(c, small, F.col("c_custkey")))])
        e.alter_table(_with(small, columns=(*small.columns, ("c_mktsegment", "string"))))
        e.apply("2", [Batch("grown", from_frame(c.where("c_custkey % 2 = 1"), e.config("grown"), F.col("c_custkey")))])
        return e.scan_current("grown").select("c_custkey", "c_name", "c_mktsegment", F.col("_schema_version").alias("schema_version"), F.col("_op").alias("op"))


def engine_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that order in a period are the whole population of it."""
    cfg, begin = TableConfig("population", ("o_custkey",), (("o_custkey", "long"), ("o_orderstatus", "string"))), "0001-01-01"
    with _database(spark, cfg) as e:
        for n, end in enumerate(PERIODS):
            at = lambda t: F.lit(t).cast("timestamp_ntz")
            own = _table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= at(begin)) & (F.col("o_orderdate") < at(end)))
            e.apply(str(n), [Batch("population", from_frame(own, cfg, F.col("o_orderkey")), True)])
            begin = end
        return e.log("population").select("o_custkey", "o_orderstatus", F.col("_op").alias("op"), (F.col("_txn_id") - 1).cast("int").alias("tx"), F.col("_valid_to").isNull().alias("is_open"))


def engine_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event holds for two hours; imported twice, the second time nothing changes."""
    cfg = TableConfig("sessions", ("user_id",), (("user_id", "long"), ("event_type", "string")))
    raw = _table(spark, sf_dir, "events").select(F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type")).alias("raw"), F.lit(False).alias("_delete"), F.lit(None).cast("timestamp").alias("_override"), F.col("event_id").alias("_ord"), F.col("ts").cast("timestamp").alias("_start"), (F.col("ts").cast("timestamp") + F.expr("interval 2 hours")).alias("_end"))
    with _database(spark, cfg) as e:
        typed = from_raw(raw, cfg, "_start", "_end")
        for n in (1, 2):
            e.apply(str(n), [Batch("sessions", from_intervals(typed, cfg))])
        return _plain(e.log("sessions").select("user_id", "event_type", F.col("_valid_from").alias("valid_from"), F.col("_valid_to").alias("valid_to"), F.col("_op").alias("op")))


def engine_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a hook publishes after each commit, read in one scan."""
    where, made = scratch(spark, "published"), []

    def publish(e: Engine) -> None:
        made.append(Publisher(e, ORDERS.table, where))
        made[-1].publish()

    with _loaded(spark, sf_dir, 2, after=publish):
        out = made[-1].read()
        return _plain(out.drop(ORDERS.valid_time_column, "_tx_time", "_schema_version").withColumn("tx", (F.col("_txn_id") - 1).cast("int")).drop("_txn_id"))


def engine_finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _loaded(spark, sf_dir) as e:
        p = Publisher(e, ORDERS.table, scratch(spark, "finalized"))
        p.publish()
        p.finalize()
        current = spark.read.parquet(p.files.at(p.files.json("_current.json")["current"]))
        return _plain(current.select("o_custkey", "o_orderstatus", "o_orderpriority", F.col("_valid_from").alias("valid_from"), F.col("_op").alias("op")))


def engine_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = _with(ORDERS, partition_by=("o_orderstatus", "o_orderpriority"))
    with _loaded(spark, sf_dir, 2, cfg) as e:
        p = Publisher(e, cfg.table, scratch(spark, "partitions"))
        p.publish()
        return p.partitions().withColumnRenamed("count", "n")


def engine_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract's SQL says of the published rows."""
    with _loaded(spark, sf_dir) as e:
        p = Publisher(e, ORDERS.table, scratch(spark, "viewed"))
        p.publish()
        view = p.files.json("_contract.json")["view"].replace(f"FROM {ORDERS.table} ", "FROM {published} ")
        out = spark.sql(view, published=p.read()).where("_is_current")
        return _plain(out.select("o_custkey", "o_orderstatus", "o_orderpriority", F.col("_valid_from").alias("valid_from"), F.col("_op").alias("op")))


def engine_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database as it was after two of three transactions, from its archive."""
    with _loaded(spark, sf_dir) as e:
        to, back = scratch(spark, "archive"), scratch(spark, "restored")
        archive.ship(e, to)
        archive.restore(spark, to, back, 3)
    return _rows(Engine(spark, back, read_only=True).log(ORDERS.table), "tx")


def engine_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _loaded(spark, sf_dir) as e:
        return _rows(change_feed(e, ORDERS.table, 3), "tx")


def engine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a stream, a transaction each."""
    path, check = scratch(spark, "stream"), scratch(spark, "stream-checkpoint")
    _raw_orders(spark, sf_dir).select(F.to_json(F.struct("*"))).write.text(path)
    with _database(spark, ORDERS) as e:
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
        rows = lambda df, cfg: from_raw(readers.decode_ops(df.select(F.from_json("value", "map<string,string>").alias("raw"), F.xxhash64("value").alias("_ord"))), cfg)
        apply_stream(e, ORDERS.table, lines, rows, check, "orders").awaitTermination()
        # A customer's rows of one instant have no order in a stream; what the newest instant says is compared where it says one thing.
        return e.scan_current(ORDERS.table).select("o_custkey")


def engine_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _loaded(spark, sf_dir) as e:
        v = e.verify()["tables"][ORDERS.table]
        return spark.createDataFrame([(v["version_records"], v["entities"], v["current_rows"])], "version_records bigint, entities bigint, current_rows bigint")


def engine_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of one order, in order: the prefix of the key is the operator's argument."""
    with _database(spark, LINES) as e:
        e.backfill("1", "lines", from_frame(_table(spark, sf_dir, "lineitem"), LINES, F.struct("l_partkey", "l_quantity", "l_returnflag")))
        first = _table(spark, sf_dir, "lineitem").agg(F.min("l_orderkey")).first()[0]
        return e.scan_prefix("lines", l_orderkey=first).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", F.col("_op").alias("op"))


def engine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reads of five keys: now, as of a time, and the length of their history."""
    with _loaded(spark, sf_dir) as e:
        out = []
        for k in range(1, 6):
            now, then, past = e.get_current(ORDERS.table, o_custkey=k), e.get_as_of(ORDERS.table, AS_OF, o_custkey=k), e.get_history(ORDERS.table, o_custkey=k)
            out.append((k, now and now["o_orderstatus"], now and now["o_orderpriority"], then and then["o_orderstatus"], len(past)))
        return spark.createDataFrame(out, "k bigint, status string, priority string, status_then string, versions bigint")


def engine_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows as JSON Lines, read back as text: instants in ISO form."""
    with _loaded(spark, sf_dir) as e:
        to = scratch(spark, "export")
        e.export(e.scan_current(ORDERS.table), ORDERS.table, to, "json")
    return spark.read.schema("o_custkey bigint, o_orderstatus string, o_orderpriority string, _valid_from string, _op string").json(to).withColumnsRenamed({"_valid_from": "valid_from", "_op": "op"})


def engine_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook sees every commit once, in order."""
    seen = []
    e = _database(spark, ORDERS)
    with e:
        e.hooks.append(lambda c: seen.append((c["txn_id"], c["type"], c.get("load_id"))))
        for n in range(2):
            e.apply(f"b{n}", [Batch(ORDERS.table, from_frame(_third(spark, sf_dir, n, 2), ORDERS, F.col("o_orderkey")))])
        e.compact(ORDERS.table)
    return spark.createDataFrame(seen, "txn bigint, type string, load_id string")


def engine_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies beside no commit goes when the database is opened, and what a commit names stays."""
    with _loaded(spark, sf_dir, 2) as e:
        root = e.files.root
    spark.range(5).write.parquet(f"{root}/tables/{ORDERS.table}/versions/txn=00000000000000000099")
    spark.range(5).write.parquet(f"{root}/staging/left")
    with Engine(spark, root):
        files = Files(spark, root)
        return spark.createDataFrame([(n,) for n in files.names("tables", ORDERS.table, "versions") + files.names("staging")], "name string")


TYPES = """
table: typed
business_key: c_custkey
schema:
  - {name: c_custkey, type: bigint}
  - {name: balance, type: "decimal(18,4)"}
  - {name: code, type: bytes}
  - {name: day, type: date}
  - {name: seen, type: timestamp}
  - {name: good, type: boolean}
  - {name: small, type: smallint}
  - {name: tags, type: "array<string>"}
  - {name: place, type: "struct<city:string,nr:int>"}
  - {name: limits, type: "map<string,bigint>"}
quality_gates:
  - {column: day, rule: "between 10000 and 10500"}
"""


def engine_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration in YAML, values as text of every kind, and a gate over days since 1970."""
    cfg = from_yaml(TYPES)
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    values = {
        "c_custkey": text(k), "balance": text(F.col("c_acctbal").cast("decimal(18,2)")), "code": F.base64(F.col("c_name").cast("binary")), "day": text(F.date_add(F.lit("1997-01-01").cast("date"), (k % 1000).cast("int"))),
        "seen": F.concat(F.lit("2001-02-03T04:05:"), F.lpad(text(k % 60), 2, "0"), F.lit("+01:00")), "good": F.when(k % 2 == 0, "yes").otherwise("0"), "small": F.concat(text(k % 100), F.lit(".0")),
        "tags": F.to_json(F.array("c_mktsegment", F.lit("x"))), "place": F.to_json(F.struct(F.col("c_name").alias("city"), (k % 7).cast("int").alias("nr"))), "limits": F.to_json(F.create_map("c_mktsegment", k)),
    }
    raw = _table(spark, sf_dir, "customer").select(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]).alias("raw"), F.lit(False).alias("_delete"), F.lit(None).cast("timestamp").alias("_override"), k.alias("_ord"))
    with _database(spark, cfg) as e:
        e.apply("1", [Batch("typed", from_raw(raw, cfg))])
        back = e.scan_current("typed").select(
            "c_custkey", F.col("balance").cast("double").alias("balance"), F.col("code").cast("string").alias("code"), "day", "seen", "good", F.col("small").cast("int").alias("small"),
            F.element_at("tags", 1).alias("tag"), "place.city", "place.nr", F.element_at("limits", F.element_at("tags", 1)).alias("most"),
        )
        return _plain(back)


def engine_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = TableConfig("keys", ("s_nationkey", "s_suppkey"), (("s_nationkey", "int"), ("s_suppkey", "long"), ("s_name", "string")))
    with _database(spark, cfg) as e:
        s = _table(spark, sf_dir, "supplier").withColumn("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey"))).withColumn("s_nationkey", F.when(F.length("s_name") > 3, F.col("s_nationkey")))
        n = e.apply("1", [Batch("keys", from_frame(s, cfg, F.xxhash64("s_name")))])["tables"]["keys"]
        return e.scan_current("keys").select("s_nationkey", "s_suppkey", "s_name", F.lit(n["rejects"]).cast("bigint").alias("rejects"))


def engine_load_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which load ids are taken, in numeric mode and otherwise; nothing is applied for the others."""
    tried = ["abc", "run-1", "-5", "0", "1.5", "99999999999999999999", "", " ", "17", "9223372036854775807", "x" * 513]
    out, small = [], TableConfig("t", ("id",), (("id", "long"),))
    with _database(spark, small) as e:
        path = e.files.root
    for numeric in (True, False):
        with Engine(spark, path, Options(numeric_load_ids=numeric)) as e:
            for i in tried:
                try:
                    e._check_load_id(i)
                    out.append((numeric, i[:20], True))
                except ConfigError:
                    out.append((numeric, i[:20], False))
    return spark.createDataFrame(out, "numeric boolean, id string, taken boolean")


def engine_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows published as Parquet, ORC, JSON and CSV parts, in folders by region."""
    cfg = TableConfig("nations", ("n_nationkey",), (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")), partition_by=("n_regionkey",))
    out = None
    with _database(spark, cfg) as e:
        e.apply("1", [Batch("nations", from_frame(_table(spark, sf_dir, "nation"), cfg, F.col("n_nationkey")))])
        for kind in ("parquet", "orc", "json", "csv"):
            p = Publisher(e, "nations", scratch(spark, kind), kind)
            p.publish()
            rows = p.current().select(F.lit(kind).alias("kind"), "n_nationkey", "n_name", "n_regionkey", F.col("_op").alias("op"))
            out = rows if out is None else out.unionByName(rows)
    return out


def engine_csv_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commas, quotes and line breaks go out as CSV and come back."""
    odd = F.concat(F.col("c_name"), F.lit(', "quoted"\n'), F.col("c_mktsegment"), F.lit(" é"))
    cfg, to = TableConfig("odd", ("c_custkey",), (("c_custkey", "long"), ("name", "string"))), scratch(spark, "odd")
    with _database(spark, cfg) as e:
        e.apply("1", [Batch("odd", from_frame(_table(spark, sf_dir, "customer").withColumn("name", odd), cfg, F.col("c_custkey")))])
        e.export(e.scan_current("odd"), "odd", to, "csv")
    with _database(spark, cfg) as e:
        load(e, readers.read(spark, to, "csv"), "odd", "back", False, None)
        return e.scan_current("odd").select("c_custkey", "name")


def engine_failed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with a failing row leaves no trace; a second bulk load of a table is refused."""
    cfg, said = _with(GATED, on_row_error="fail_batch"), []
    customer = _table(spark, sf_dir, "customer")
    with _database(spark, cfg, CUSTOMERS) as e:
        tries = [lambda: e.apply("1", [Batch("customer", from_frame(customer, cfg, F.col("c_custkey")))])]
        tries += [lambda n=n: e.backfill(n, "customers", from_frame(customer, CUSTOMERS, F.col("c_custkey"))) for n in ("2", "3")]
        for t in tries:
            try:
                t()
                said.append("done")
            except EngineError:
                said.append("refused")
        left = e.files.names("staging")
        return e.scan_current("customers").agg(F.count("*").alias("n")).select("n", F.lit(",".join(said)).alias("said"), F.lit(len(e.commits())).cast("bigint").alias("commits"), F.lit(len(left)).cast("bigint").alias("left"))


def engine_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _database(spark, CUSTOMERS, SUPPLIERS, *PLACES) as e:
        rows = [(t, n, kind, n in c.business_key) for t, c in e.tables().items() for n, kind in c.columns]
        return spark.createDataFrame(rows, "t string, name string, kind string, is_key boolean")


def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over all transactions, and how many of them publication is behind."""
    cfg = _with(ORDERS, publish_location=scratch(spark, "lag"))
    with _loaded(spark, sf_dir, 3, cfg, after=lambda e: Publisher(e, cfg.table).publish() if len(e.commits()) == 2 else None) as e:
        t = e.stats()
        return spark.createDataFrame([(t["transactions"], t["tables"], t["publish_lag"][cfg.table], t["rows_in"], t["inserts"], t["updates"])], "transactions bigint, tables bigint, lag bigint, rows_in bigint, inserts bigint, updates bigint")


def engine_snapshot_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy in a new place is a database of its own: a transaction there changes it alone."""
    with _loaded(spark, sf_dir, 2) as e:
        to, back = scratch(spark, "copy"), scratch(spark, "copied")
        archive.snapshot(e, to)
        archive.vacuum(e)
        archive.restore(spark, to, back)
        with Engine(spark, back) as other:
            gone = from_frame(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("2031-01-01").cast("timestamp").alias("o_orderdate")), ORDERS, F.col("o_custkey"), F.lit(True))
            other.apply("gone", [Batch(ORDERS.table, gone)])
            there = other.scan_current(ORDERS.table).count()
        return _rows(e.scan_current(ORDERS.table)).withColumn("there", F.lit(there).cast("bigint"))


def engine_stream_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is started again goes on where it stopped; its receipts and versions are those of one run."""
    path, check = scratch(spark, "again"), scratch(spark, "again-checkpoint")
    lines = _raw_orders(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    rows = lambda df, cfg: from_raw(readers.decode_ops(df.select(F.from_json("value", "map<string,string>").alias("raw"), F.xxhash64("value").alias("_ord"))), cfg)
    with _database(spark, ORDERS) as e:
        for n in range(2):
            lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == n).write.mode("append").text(path)
            for _ in range(2):
                apply_stream(e, ORDERS.table, spark.readStream.text(path), rows, check, "again").awaitTermination()
        total = sum(c["tables"][ORDERS.table]["rows_in"] for c in e.manifests())
        return e.scan_current(ORDERS.table).agg(F.count("*").alias("current_rows")).select("current_rows", F.lit(total).cast("bigint").alias("rows_in"), F.lit(len(e.manifests())).cast("bigint").alias("transactions"))


def engine_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as a stream out of the database, each once, past a compaction."""
    to, check = scratch(spark, "changes"), scratch(spark, "changes-checkpoint")
    with _loaded(spark, sf_dir) as e:
        for again in range(2):
            if again:
                e.compact(ORDERS.table)
            change_stream(spark, e, ORDERS.table).writeStream.format("parquet").option("checkpointLocation", check).option("path", to).trigger(availableNow=True).start().awaitTermination()
        out = spark.read.parquet(to)
    return _rows(out, "tx")


def engine_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line over one database: what each command answers about nation 3, and its exit code."""
    db, where = scratch(spark, "commands"), scratch(spark, "commands-in")
    _table(spark, sf_dir, "nation").coalesce(1).write.json(where)
    out = []

    def say(what: str, *args: str, read=lambda x: None) -> None:
        try:
            code, found = 0, cli.run(cli.parser().parse_args(["--db", db, *args]), spark)
        except ConfigError:
            code, found = 2, None
        except EngineError:
            code, found = 1, None
        out.append((what, code, None if found is None else read(found)))

    with Engine(spark, db) as e:
        e.create_table(PLACES[0])
    say("apply", "apply", where, "--table", "nation", "--format", "jsonl", "--load-id", "1", read=lambda x: str(x["tables"]["nation"]["inserts"]))
    say("again", "apply", where, "--table", "nation", "--format", "jsonl", "--load-id", "1", read=lambda x: str(x["txn_id"]))
    say("get", "get", "nation", "n_nationkey=3", read=lambda x: x["n_name"])
    say("none", "get", "nation", "n_nationkey=999")
    say("history", "history", "nation", "n_nationkey=3", read=lambda x: str(len(x)))
    say("bad key", "get", "nation", "n_nationkey")
    say("other table", "get", "elsewhere", "n_nationkey=3")
    say("scan", "scan", "nation", read=lambda x: str(len(list(x))))
    say("list", "table", "list", read=lambda x: ",".join(x))
    say("compact", "compact", "nation", read=lambda x: x["type"])
    return spark.createDataFrame(out, "command string, code int, answer string")


QUERIES = {
    f.__name__: f
    for f in (
        engine_jsonl, engine_csv, engine_json_arrays, engine_document, engine_envelope, engine_history, engine_current, engine_asof, engine_compacted, engine_manifests, engine_replay, engine_multi_table,
        engine_skipped, engine_quarantined, engine_reapplied, engine_late_quarantine, engine_grown, engine_snapshots, engine_intervals, engine_published, engine_finalized, engine_partitions, engine_view,
        engine_restored, engine_changes, engine_stream, engine_verified, engine_prefix, engine_points, engine_export, engine_hooks, engine_files,
        engine_types, engine_null_keys, engine_load_ids, engine_formats, engine_csv_quotes, engine_failed_batch, engine_described, engine_stats, engine_snapshot_copy, engine_stream_twice, engine_change_stream, engine_commands,
    )
}
