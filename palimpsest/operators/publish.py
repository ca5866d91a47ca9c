"""Publication: the state as open files for other engines, each transaction exactly once.

<location>/_contract.json, _commit_log/<n>.json (which files are live), data/part=<n>/ in any format that Spark writes, partitions/n=<n>/ (rows by partition, a table). A reader trusts the log; folders that it does not name are swept
by the next publication.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import TableConfig
from ..plans.files import Files
from ..plans.store import Engine, EngineError
from .decide import DELETE, touched
from .reads import _newest

FORMAT = "bitemporal-open-v1"


def render(log: DataFrame, cfg: TableConfig) -> DataFrame:
    """Versions as they are published: payload, start, end, transaction, and where the style has operations, those.

    Without operations there are no tombstones. A deletion at the very start of a version would then leave that version open, so it is published as one that ends where it starts.
    """
    start, end, ops = cfg.start_end_ops
    out = log
    if not ops:
        # A tombstone at an instant of a version replaces it; at any other it closes the version before, which is a row of its own.
        w = Window.partitionBy(*cfg.business_key, "_valid_from").orderBy("_tx")
        replaces = F.coalesce(F.lag("_op").over(w) != DELETE, F.lit(False))
        out = log.withColumn("_replaces", replaces).where((F.col("_op") != DELETE) | F.col("_replaces"))
        out = out.withColumn("_valid_to", F.when(F.col("_op") == DELETE, F.col("_valid_from")).otherwise(F.col("_valid_to"))).drop("_replaces")
    columns = [F.col(c) for c in cfg.names] + [F.col("_valid_from").alias(start), F.col("_valid_to").alias(end), F.col("_tx").alias("_tx_time")]
    columns += [F.col(c) for c in ("_txn_id", "_schema_version") if c in log.columns]
    if ops:
        columns.append(F.col("_op"))
    return out.select(*columns)


def consolidate(published: DataFrame, cfg: TableConfig) -> DataFrame:
    """What a finalized table says now: of each (key, start) the newest belief, with the end it has or the next start, and _is_current."""
    start, end, ops = cfg.start_end_ops
    newest = Window.partitionBy(*cfg.business_key, start).orderBy(F.desc("_tx_time"))
    chain = Window.partitionBy(*cfg.business_key).orderBy(start)
    out = published.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    out = out.withColumn(end, F.coalesce(end, F.lead(start).over(chain)))
    alive = F.col("_op") != DELETE if ops else F.lit(True)
    return out.withColumn("_is_current", alive & F.col(end).isNull())


def view_sql(cfg: TableConfig, source: str) -> str:
    """The same as SQL: of each key and start the row that was learned last (max_by), and as its end the least start after it where it has none."""
    start, end, ops = cfg.start_end_ops
    by = [*cfg.business_key, start]
    rest = [c for c in [*cfg.names, end, "_tx_time", "_txn_id", "_schema_version", *(["_op"] if ops else [])] if c not in by]
    said = ", ".join(f"max_by({c}, _tx_time) AS {c}" if c != "_tx_time" else "max(_tx_time) AS _tx_time" for c in rest)
    nullable = f"max_by(struct({end}), _tx_time).{end} AS {end}"  # the last row's end may be null, and must then stay so
    said = said.replace(f"max_by({end}, _tx_time) AS {end}", nullable)
    after = f"min({start}) OVER (PARTITION BY {', '.join(cfg.business_key)} ORDER BY {start} ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING)"
    alive = f"(_op <> '{DELETE}') AND " if ops else ""
    shown = ", ".join(c for c in [*by, *rest] if c != end)
    return f"SELECT *, {alive}{end} IS NULL AS _is_current FROM (SELECT {shown}, ifnull({end}, {after}) AS {end} FROM (SELECT {', '.join(by)}, {said} FROM {source} GROUP BY {', '.join(by)}) AS said) AS told"


class Publisher:
    """Publishes a table's transactions in order; as a hook of an engine, after each commit."""

    def __init__(self, engine: Engine, table: str, location: str | None = None, kind: str = "parquet"):
        self.engine, self.table, self.kind = engine, table, kind
        self.cfg = engine.config(table)
        where = location or self.cfg.publish_location
        if not where:
            raise ValueError(f"{table} has no location to publish to")
        self.files = Files(engine.spark, where)
        self._known: list[dict] = []

    def _log(self) -> list[dict]:
        names = [n for n in self.files.names("_commit_log") if n.endswith(".json") and not n.startswith(".")]
        self._known += [self.files.json("_commit_log", n) for n in names[len(self._known) :]]
        return list(self._known)

    def _live(self) -> list[str]:
        out: list[str] = []
        for e in self._log():
            out = [x for x in out if x not in e.get("replaces", ())] + e["files"]
        return out

    def _sweep(self) -> None:
        """Deletes parts that the log does not name; only a publisher that is about to write does."""
        if self.engine.read_only:
            raise EngineError("this engine only reads")
        live = set(self._live())
        for n in self.files.names("data"):
            if f"data/{n}" not in live:
                self.files.delete("data", n)

    @property
    def watermark(self) -> int:
        return max((e["txn_to"] for e in self._log()), default=0)

    def publish(self) -> dict | None:
        """Appends what was committed since the watermark; None if there is nothing new."""
        self._sweep()
        commits, mark = self.engine.commits(), self.watermark
        new = [c for c in commits if c["txn_id"] > mark and self.table in c.get("tables", {})]
        if not new:
            return None
        self.cfg = self.engine.config(self.table, commits)
        names = [x for c in new for x in c["tables"][self.table]["data"] if x.startswith("tables/")]
        log = self.engine._read(names, self.cfg).drop("_bucket")
        if not self.cfg.start_end_ops[2]:
            # Whether a tombstone replaces a version shows only beside the versions before, of the same keys.
            keys = log.select(*self.cfg.business_key).distinct()
            whole = render(touched(self.engine._touched_log(self.table, self.cfg, keys, commits), keys, self.cfg), self.cfg)
            rows = whole.where((F.col("_txn_id") >= new[0]["txn_id"]) & (F.col("_txn_id") <= new[-1]["txn_id"]))
        else:
            rows = render(log, self.cfg)
        return self._append(rows, new[-1]["txn_id"], new[0]["txn_id"], [c.get("load_id") for c in new])

    def _append(self, rows: DataFrame, txn_to: int, txn_from: int, load_ids: list, replaces: list[str] = (), name: str = "part") -> dict:
        n = len(self._log()) + 1
        to = f"data/{name}={n:010d}"
        self.files.delete(to)  # what a crash may have left
        parts = list(self.cfg.partition_by)
        writer = rows.withColumns({f"_p_{c}": F.col(c) for c in parts}).write.format(self.kind)
        # Partition columns stay in the files too, beside the folders' _p_ columns.
        (writer.partitionBy(*[f"_p_{c}" for c in parts]) if parts else writer).save(self.files.at(to))
        back = self.engine.spark.read.format(self.kind).schema(rows.schema).load(self.files.at(to))
        counts = f"partitions/n={n:010d}"
        self.files.delete(counts)
        back.groupBy(*parts).agg(F.count("*").alias("count")).write.parquet(self.files.at(counts))
        total = self.engine.spark.read.parquet(self.files.at(counts)).agg(F.count("*"), F.sum("count")).first()
        entry = {"n": n, "txn_from": txn_from, "txn_to": txn_to, "load_ids": load_ids, "files": [to], "replaces": list(replaces), "rows": total[1] or 0, "partitions": total[0], "partition_counts": counts}
        if not self.files.exists("_contract.json"):
            start, end, ops = self.cfg.start_end_ops
            contract = {"format": FORMAT, "table": self.table, "business_key": self.cfg.business_key, "start": start, "end": end, "operations": ops, "partition_by": parts, "file_format": self.kind, "view": view_sql(self.cfg, self.table)}
            self.files.create(json.dumps(contract), "_contract.json")
        if not self.files.create(json.dumps(entry, default=str), "_commit_log", f"{n:010d}.json"):
            raise RuntimeError(f"{self.files.root} is published to by another")
        return entry

    def read(self) -> DataFrame:
        """All published rows that are live, in one scan of the parts."""
        _, _, ops = self.cfg.start_end_ops
        schema = render(self.engine._read([], self.cfg).drop("_bucket"), self.cfg).schema
        live = [self.files.at(x) for x in self._live()]
        if not live:
            return self.engine.spark.createDataFrame([], schema)
        # Partition columns are in the files too, so folders' names say nothing.
        return self.engine.spark.read.format(self.kind).schema(schema).option("recursiveFileLookup", "true").load(live)

    def partitions(self) -> DataFrame:
        """The live parts' rows by partition: as many rows as there are partitions."""
        live, parts = set(self._live()), list(self.cfg.partition_by)
        names = [e["partition_counts"] for e in self._log() if set(e["files"]) <= live]
        schema = ", ".join([*[f"`{c}` {self.cfg.types[c].simpleString()}" for c in parts], "count bigint"])
        if not names:
            return self.engine.spark.createDataFrame([], schema)
        return self.engine.spark.read.schema(schema).parquet(*map(self.files.at, names)).groupBy(*parts).agg(F.sum("count").alias("count"))

    def current(self) -> DataFrame:
        """consolidate()'s current rows: only the newest belief of a key's last start can be open, so one aggregate by key finds it."""
        rows = self.read()
        start, end, ops = self.cfg.start_end_ops
        newest = _newest(rows, list(self.cfg.business_key), F.struct(F.col(start), F.col("_tx_time"))).select(*rows.columns)
        alive = F.col("_op") != DELETE if ops else F.lit(True)
        return newest.withColumn("_is_current", alive & F.col(end).isNull()).where("_is_current")

    def finalize(self) -> dict:
        """All parts become one sorted log, and a materialized current table stands beside it."""
        self._sweep()
        live, rows = self._live(), self.read()
        start = self.cfg.start_end_ops[0]
        key = list(self.cfg.business_key)
        entry = self._append(rows.repartition(*key).sortWithinPartitions(*key, start, "_tx_time"), self.watermark, 0, [], live, "final")
        to = f"current/n={entry['n']:010d}"
        now = self.current()
        now.write.format(self.kind).save(self.files.at(to))
        self.files.replace(json.dumps({"current": to, "view": view_sql(self.cfg, self.table)}), "_current.json")
        self._sweep()
        # Counts of what was written: the entry's are of its part, which is now the only one.
        return entry | {"current": to, "log_rows": entry["rows"], "current_rows": self.engine.spark.read.format(self.kind).schema(now.schema).load(self.files.at(to)).count()}
