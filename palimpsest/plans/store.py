"""The engine: atomic, idempotent transactions over tables whose beliefs are only ever added to.

<db>/LOCK                            who writes; its holder touches it, and it counts for LEASE seconds after that or until its process is gone
<db>/_commit_log/<txn>.json          created whole, exclusively, with a checksum of itself; the only source of truth
<db>/_commit_checkpoints/<txn>.json  all commits up to one, every CHECKPOINT of them: opening a database reads one of these and the few commits after it
<db>/tables/<t>/versions/txn=<n>/    Parquet, in buckets of the business key
<db>/quarantine/<t>/txn=<n>/         rows that were diverted
<db>/resolved/<t>/txn=<n>/           ids of diverted rows that a later transaction took
<db>/staging/                        work in progress; whatever no commit names is swept

A transaction stages, decides and writes each table once, counts from what it wrote, and commits by one file. A crash before that leaves files that nobody reads. A batch reads only those buckets of
the log that its keys fall in, and of them only its keys' rows. How many buckets a table has is written in the commit that makes it (Options.buckets is for new tables only); compact() may raise it. Within
a bucket rows are dealt over as many tasks as the session has shuffle partitions.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import threading
import time
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import render
from ..operators import decide as d
from ..operators import reads
from ..operators.stage import stage, with_effective_time
from .config import ConfigError, TableConfig, altered
from .files import Files

COUNTERS = ("rows_in", "inserts", "updates", "no_ops", "deletes", "late_splits", "rejects", "quarantined")
STAMPS = ("_valid_from timestamp", "_valid_to timestamp", "_op string", "_tx timestamp", "_txn_id bigint", "_schema_version int")


class EngineError(RuntimeError):
    """A transaction that was refused; nothing of it was applied."""


@dataclass(frozen=True)
class Options:
    max_manifest_errors: int = 100
    publish_enabled: bool = True
    numeric_load_ids: bool = False
    buckets: int = 16


#: Seconds that a lock counts for after its holder last touched it; commits between checkpoints; bytes of versions that a bucket holds on average after compact().
LEASE, CHECKPOINT, BUCKET_BYTES = 300, 100, 512 << 20


@dataclass(frozen=True)
class Batch:
    """One table's rows: as operators.stage makes them. full_snapshot: current entities that it does not name are deleted."""

    table: str
    rows: DataFrame
    full_snapshot: bool = False
    effective_at: datetime | None = None


def _micros(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000 + 0.5)


def _checksum(commit: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in commit.items() if k != "checksum"}, sort_keys=True).encode()).hexdigest()


def _checked(commit: dict) -> dict:
    if commit.get("checksum") != _checksum(commit):
        raise EngineError(f"commit {commit.get('txn_id')} is damaged")
    return commit


class Engine:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, read_only: bool = False):
        self.spark, self.files, self.options, self.read_only = spark, Files(spark, path), options or Options(), read_only
        self.hooks: list = []
        self._known: list[dict] = []
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        if not read_only:
            self._lock(path)
            self._sweep()

    # The lock.

    def _lock(self, path: str) -> None:
        self.token = json.dumps({"app": self.spark.sparkContext.applicationId, "host": socket.gethostname(), "pid": os.getpid(), "since": datetime.now(UTC).isoformat(), "id": uuid.uuid4().hex})
        if not self.files.create(self.token, "LOCK"):
            if not self._forsaken():
                raise EngineError(f"{path} is open for writing elsewhere: {self.files.read('LOCK')}")
            self.unlock()
            if not self.files.create(self.token, "LOCK"):
                raise EngineError(f"{path} was opened for writing elsewhere: {self.files.read('LOCK')}")
        self._closed = threading.Event()
        threading.Thread(target=self._hold, daemon=True).start()

    def _forsaken(self) -> bool:
        """Whether the lock's holder is gone: its process on this machine has ended, or nobody has touched the lock for LEASE seconds."""
        try:
            holder, age = json.loads(self.files.read("LOCK")), self.files.age("LOCK")
        except Exception:  # noqa: BLE001  it went meanwhile
            return not self.files.exists("LOCK")
        if holder.get("host") == socket.gethostname() and holder.get("pid"):
            try:
                os.kill(holder["pid"], 0)
            except ProcessLookupError:
                return True
            except PermissionError:
                pass
        return age > LEASE

    def _hold(self) -> None:
        while not self._closed.wait(LEASE / 5):
            try:
                if self.files.read("LOCK") != self.token:
                    return
                self.files.touch("LOCK")
            except Exception:  # noqa: BLE001  the session may have ended
                return

    def unlock(self) -> None:
        """Takes a lock away, whoever holds it; a holder that lives notices before its next commit."""
        self.files.delete("LOCK")

    def close(self) -> None:
        if not self.read_only:
            self._closed.set()
            if self.files.exists("LOCK") and self.files.read("LOCK") == self.token:
                self.files.delete("LOCK")
        self.read_only = True

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # The log of commits.

    def commits(self, upto: int | None = None) -> list[dict]:
        """All commits in order; a caller that resolves them once reads one state. What was read once is kept: commits never change."""
        names = sorted(int(n[:-5]) for n in self.files.names("_commit_log") if n.endswith(".json") and not n.startswith("."))
        if names != list(range(1, len(names) + 1)):
            raise EngineError(f"commit {next(i for i, n in enumerate(names, 1) if n != i)} is missing")
        if not self._known and len(names) > CHECKPOINT:
            points = [n for n in self.files.names("_commit_checkpoints") if n.endswith(".json") and not n.startswith(".") and int(n[:-5]) <= len(names)]
            if points:
                self._known = [_checked(c) for c in self.files.json("_commit_checkpoints", points[-1])]
        if len(self._known) > len(names):
            self._known = []
        for n in names[len(self._known) :]:
            commit = _checked(self.files.json("_commit_log", f"{n:020d}.json"))
            if commit["txn_id"] != n:
                raise EngineError(f"commit {n} is not what it is called")
            self._known.append(commit)
        return self._known[: len(names) if upto is None else upto]

    def tables(self, commits: list[dict] | None = None) -> dict[str, TableConfig]:
        out: dict[str, TableConfig] = {}
        for c in self.commits() if commits is None else commits:
            for t in c.get("configs", ()):
                out[t["table"]] = TableConfig.from_dict(t)
        return dict(sorted(out.items()))

    def config(self, table: str, commits: list[dict] | None = None) -> TableConfig:
        found = self.tables(commits).get(table)
        if not found:
            raise EngineError(f"no such table: {table}")
        return found

    def _commit(self, commit: dict) -> dict:
        if self.read_only:
            raise EngineError("this engine only reads")
        if not self.files.exists("LOCK") or self.files.read("LOCK") != self.token:
            raise EngineError("the lock was taken by another writer; nothing was applied")
        name = f"{commit['txn_id']:020d}.json"
        commit = json.loads(json.dumps(commit, default=str))
        commit["checksum"] = _checksum(commit)
        if not self.files.create(json.dumps(commit), "_commit_log", name):
            raise EngineError(f"transaction {commit['txn_id']} was committed by another writer")
        if commit["txn_id"] % CHECKPOINT == 0:
            self.files.create(json.dumps(self.commits()), "_commit_checkpoints", name)
        for hook in self.hooks:
            hook(commit)
        return commit

    def _next(self, commits: list[dict]) -> tuple[int, int]:
        """(transaction, tx_time in microseconds): later than any committed one, whatever the clock says."""
        last = max((c["tx_time"] for c in commits), default=0)
        return len(commits) + 1, max(_micros(datetime.now(UTC)), last + 1)

    def _sweep(self) -> None:
        """Deletes what no commit names."""
        self.files.delete("staging")
        named = {x for c in self.commits() for part in c.get("tables", {}).values() for x in part["data"]} | {x for c in self.commits() for x in c.get("data", ())}
        for top in ("tables", "quarantine", "resolved"):
            for t in self.files.names(top):
                inner = (top, t, "versions") if top == "tables" else (top, t)
                for txn in self.files.names(*inner):
                    if "/".join((*inner, txn)) not in named:
                        self.files.delete(*inner, txn)

    # Tables.

    def create_table(self, config: TableConfig) -> dict:
        commits = self.commits()
        if config.table in self.tables(commits):
            raise EngineError(f"table exists: {config.table}")
        return self._config(config, commits)

    def alter_table(self, config: TableConfig) -> dict:
        commits = self.commits()
        return self._config(altered(self.config(config.table, commits), config), commits)

    def _config(self, config: TableConfig, commits: list[dict]) -> dict:
        txn, tx = self._next(commits)
        made = {} if config.table in self.tables(commits) else {"buckets": {config.table: self.options.buckets}}
        return self._commit({"type": "config", "txn_id": txn, "tx_time": tx, "configs": [config.to_dict()], "config_hash": config.hash} | made)

    # Writing.

    def _check_load_id(self, load_id: str) -> None:
        if not load_id or not load_id.strip() or len(load_id) > 512:
            raise ConfigError("a load id has 1 to 512 characters and is not blank")
        if self.options.numeric_load_ids and not (load_id.isascii() and load_id.isdigit() and not load_id.startswith("0") and 1 <= int(load_id) < 1 << 63):
            raise ConfigError(f"load ids are whole numbers from 1 here: {load_id}")

    @staticmethod
    def _marks(rows: DataFrame) -> DataFrame:
        """rows with two hashes of each row and its place in the input; the file that it was read from and how that was split are no part of it."""
        said: list = []

        def say(c, kind: T.DataType) -> None:
            # A hash passes over nulls, so it is told of each value whether it is one.
            said.append(c.isNull())
            if isinstance(kind, T.StructType):
                for f in kind.fields:
                    say(c.getField(f.name), f.dataType)
            else:
                said.append(F.to_json(c) if isinstance(kind, T.ArrayType | T.MapType) else c)

        for f in rows.schema.fields:
            if f.name == "_ord" and isinstance(f.dataType, T.StructType):
                for part in f.dataType.fields:
                    if part.name != "file":
                        say(F.col("_ord").getField(part.name), part.dataType)
            elif f.name == "_absent":
                said.append(F.col("_absent"))
            else:
                say(F.col(f"`{f.name}`"), f.dataType)
        return rows.withColumns({"_mark_x": F.xxhash64(*said), "_mark_y": F.xxhash64(F.lit("y"), *said)})

    @staticmethod
    def _print(batch: Batch, marked: DataFrame) -> str:
        """A hash of what a caller handed in: its rows with their places, as a set."""
        r = marked.agg(F.count("*"), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("_mark_x", "_mark_y")]).first()
        return f"{batch.table} {batch.full_snapshot} {batch.effective_at} {tuple(map(str, r))}"

    def apply(self, load_id: str, batches: list[Batch], metadata: dict | None = None, resolved: dict[str, DataFrame] | None = None) -> dict:
        """One transaction over one or more tables. The same load id with the same content returns the first manifest; with other content it is refused."""
        self._check_load_id(load_id)
        if len({b.table for b in batches}) != len(batches) or not batches:
            raise ConfigError("a transaction names each of its tables once")
        commits = self.commits()
        used = next((c for c in commits if c.get("load_id") == load_id), None)
        if used:
            if used["fingerprint"] != self._joined([self._print(b, self._marks(b.rows)) for b in batches]):
                raise EngineError(f"load id {load_id} was used with DIFFERENT content; nothing was applied")
            return used
        txn, tx = self._next(commits)
        began, parts, prints, work = time.time(), {}, [], f"staging/{uuid.uuid4().hex}"
        try:
            for b in batches:
                parts[b.table], mark = self._table(b, self.config(b.table, commits), commits, txn, tx, work)
                prints.append(mark)
            for t, ids in (resolved or {}).items():
                to = f"resolved/{t}/txn={txn:020d}"
                ids.select("id").write.parquet(self.files.at(to))
                parts[t]["data"].append(to)
            commit = {"type": "data", "txn_id": txn, "tx_time": tx, "load_id": load_id, "fingerprint": self._joined(prints), "metadata": metadata or {}, "tables": parts, "seconds": round(time.time() - began, 3)}
            return self._commit(commit)
        except Exception:
            for name in [x for p in parts.values() for x in p["data"]]:
                self.files.delete(name)
            raise
        finally:
            self.files.delete(work)

    @staticmethod
    def _joined(prints: list[str]) -> str:
        return hashlib.sha256("\n".join(sorted(prints)).encode()).hexdigest()

    def _table(self, b: Batch, cfg: TableConfig, commits: list[dict], txn: int, tx: int, work: str) -> tuple[dict, str]:
        """(the part of the manifest, the print of what came in). Rows are staged once, decided once and written once; counts come from what was written."""
        name = b.table
        tx_time = F.timestamp_micros(F.lit(tx))
        rows = self._marks(b.rows)
        rows = with_effective_time(rows, F.lit(b.effective_at).cast("timestamp"), cfg) if b.effective_at else rows
        # What a row was before it was typed is asked of failed rows alone.
        judged = stage(rows, cfg, tx_time)
        staged = self._written(judged.withColumn("_raw", F.when(F.col("_reason").isNotNull(), F.col("_raw"))), f"{work}/{name}/staged")
        failed = staged.where("_reason is not null")
        totals = staged.agg(F.count("*"), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("_mark_x", "_mark_y")], F.count("_reason"), F.count(F.when(F.col("_reason").isNull() & F.col("_delete"), 1))).first()
        mark = f"{b.table} {b.full_snapshot} {b.effective_at} {tuple(map(str, totals[:3]))}"
        rows_in, bad, deletes = totals[0], totals[3], totals[4]
        n = dict.fromkeys(COUNTERS, 0) | {"rows_in": rows_in}
        if bad and cfg.on_row_error == "fail_batch":
            first = failed.orderBy("_ord").first()
            raise EngineError(f"{name}: {bad} rows failed, the first by: {first['_reason']}")
        keyed = staged.where("_reason is null").select(*cfg.names, "_valid_from", "_delete", "_absent", "_ord")
        absent, loaded = 0, bool(self.data_of(name, commits))
        if b.full_snapshot and loaded:
            seen = staged.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cfg.business_key]))
            gone = d.missing_keys(reads.current(self.log(name, commits), cfg), seen, cfg, tx_time)
            gone = self._written(gone, f"{work}/{name}/gone")
            keyed = keyed.unionByName(gone.withColumn("_ord", F.lit(None).cast(keyed.schema["_ord"].dataType)))
            absent = gone.count()
        buckets = self.buckets(name, commits)
        if loaded:
            state = d.touched(self._touched_log(name, cfg, keyed, commits), keyed, cfg)
        else:
            state = self._read([], cfg)
        # Dealt as versions are written, so that one exchange serves both.
        decision = d.decide(state, keyed, cfg, {"_bucket": self._bucket(cfg, buckets), "_share": self._share(cfg, buckets, 4)})
        out = f"tables/{name}/versions/txn={txn:020d}"
        stamped = decision.changes.withColumns({"_tx": tx_time, "_txn_id": F.lit(txn).cast("bigint"), "_schema_version": F.lit(cfg.schema_version)})
        stamped.sortWithinPartitions("_bucket", *cfg.business_key, "_valid_from").write.partitionBy("_bucket").parquet(self.files.at(out))
        data = [out]
        written = self._read([out], cfg, extra="_outcome string, _late boolean")
        by = {r["_outcome"]: (r["n"], r["late"]) for r in written.groupBy("_outcome").agg(F.count("*").alias("n"), F.sum(F.col("_late").cast("long")).alias("late")).collect()}
        for outcome in ("insert", "update", "delete"):
            n[f"{outcome}s"] = by.get(outcome, (0, 0))[0]
        n["late_splits"] = sum(x[1] or 0 for x in by.values())
        # Rows that take no part. Where the only kind is a repeated instant that a later row wins, their number is all that is needed.
        refused = None
        if cfg.same_batch_duplicates == "reject" or (loaded and cfg.late_policy != "split") or (deletes and cfg.deletes == "ignore"):
            refused = self._written(decision.refused, f"{work}/{name}/refused")
            fates = {r["_fate"]: r["count"] for r in refused.groupBy("_fate").count().collect()}
        else:
            instants = keyed.groupBy(*cfg.business_key, "_valid_from").agg(F.count("*").alias("n"))
            fates = {"dup": instants.agg(F.sum(F.col("n") - 1)).first()[0] or 0}
        n["rejects"] = (0 if cfg.on_row_error == "quarantine" else bad) + fates.get("dup_reject", 0) + fates.get("late_reject", 0)
        n["quarantined"] = (bad if cfg.on_row_error == "quarantine" else 0) + fates.get("late_quarantine", 0)
        n["no_ops"] = rows_in - bad + absent - sum(fates.values()) + fates.get("ignored", 0) - n["inserts"] - n["updates"] - n["deletes"]
        most, errors = self.options.max_manifest_errors, []
        if bad:
            errors = [{"ordinal": str(r["_ord"]), "reason": r["_reason"]} for r in failed.orderBy("_ord").select("_ord", "_reason").limit(most).collect()]
        if n["rejects"] > len(errors) and refused is not None:
            errors += [{"ordinal": None, "reason": f"{r['_fate'].replace('_', ' ')} at {r['_valid_from']}"} for r in refused.where(F.col("_fate").isin("dup_reject", "late_reject")).select("_fate", "_valid_from").limit(max(0, most - len(errors))).collect()]
        if n["quarantined"]:
            to = f"quarantine/{name}/txn={txn:020d}"
            late = decision.refused.limit(0) if refused is None else refused.where("_fate = 'late_quarantine'")
            self._quarantine(failed if cfg.on_row_error == "quarantine" else failed.limit(0), late, cfg, txn, tx_time).write.parquet(self.files.at(to))
            data.append(to)
        return n | {"errors": errors, "data": data, "config_hash": cfg.hash, "schema_version": cfg.schema_version}, mark

    def _put(self, stamped: DataFrame, cfg: TableConfig, buckets: int, name: str) -> None:
        """Writes versions with _bucket by bucket, each bucket dealt over several tasks by key; sorted by key and time, so that statistics of row groups serve point reads."""
        share = self._share(cfg, buckets)
        order = [c for c in (*cfg.business_key, "_valid_from", "_tx") if c in stamped.columns]
        stamped.repartition("_bucket", share).sortWithinPartitions("_bucket", *order).write.partitionBy("_bucket").parquet(self.files.at(name))

    def _share(self, cfg: TableConfig, buckets: int, times: int = 1):
        """The part of its bucket that a key is in, of so many that all buckets have `times` the session's shuffle partitions: more are dealt more evenly."""
        shares = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) * times // buckets))
        return F.pmod(F.xxhash64(F.lit("share"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cfg.business_key]), F.lit(shares))

    def _quarantine(self, failed: DataFrame, late: DataFrame, cfg: TableConfig, txn: int, tx_time) -> DataFrame:
        values = F.map_filter(F.create_map(*[x for c in cfg.names for x in (F.lit(c), F.when(F.array_contains("_absent", c), F.lit(None)).otherwise(F.col(c).cast("string") if not isinstance(cfg.types[c], T.ArrayType | T.MapType | T.StructType | T.BinaryType) else F.base64(c) if isinstance(cfg.types[c], T.BinaryType) else F.to_json(c)))]), lambda k, v: v.isNotNull())
        one = failed.select(F.col("_reason").alias("reason"), F.coalesce("_raw", values).alias("raw"), "_delete", F.col("_override"), F.to_json(F.struct("_ord")).alias("o"))
        two = late.select(F.lit("late arrival").alias("reason"), values.alias("raw"), "_delete", F.col("_valid_from").alias("_override"), F.to_json(F.struct("_ord")).alias("o"))
        return one.unionByName(two).select(F.concat_ws("-", F.lit(f"{txn:012d}"), F.sha2(F.concat_ws("|", "o", "reason", F.to_json("raw")), 256).substr(1, 16)).alias("id"), "reason", "raw", "_delete", "_override", tx_time.alias("at"))

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """df evaluated once: decisions feed both rows and counters."""
        df.write.parquet(self.files.at(name))
        return self.spark.read.schema(df.schema).parquet(self.files.at(name))

    def buckets(self, table: str, commits: list[dict]) -> int:
        """How many buckets a table's versions are in: what the newest commit that says so says."""
        return next((c["buckets"][table] for c in reversed(commits) if table in c.get("buckets", {})), 16)

    def _bucket(self, cfg: TableConfig, buckets: int, key: dict | None = None):
        return F.pmod(F.xxhash64(*[F.coalesce((key[c] if key else F.col(c)).cast("string"), F.lit("")) for c in cfg.business_key]), F.lit(buckets)).cast("int")

    def _read(self, names: list[str], cfg: TableConfig, extra: str = "") -> DataFrame:
        """Versions by name with the current schema; columns that older files lack are null."""
        schema = T.StructType(cfg.schema.fields)
        for part in [*STAMPS, *[x.strip() for x in extra.split(",") if x], "_bucket int"]:
            c, kind = part.split()
            schema = schema.add(c, {"timestamp": "timestamp", "string": "string", "bigint": "long", "int": "integer", "boolean": "boolean"}[kind])
        if not names:
            return self.spark.createDataFrame([], schema)
        # One scan, however many transactions: transaction and bucket are folders, so both can be pruned.
        top = self.files.at(names[0].rsplit("/", 1)[0])
        return self.spark.read.schema(schema.add("txn", "long")).option("basePath", top).parquet(*map(self.files.at, names)).drop("txn")

    def _touched_log(self, table: str, cfg: TableConfig, keys: DataFrame, commits: list[dict]) -> DataFrame:
        """The log's rows in the buckets that the keys fall in: the filter prunes folders."""
        log = self.log(table, commits, bucket=True)
        buckets = self.buckets(table, commits)
        own = [r[0] for r in keys.select(self._bucket(cfg, buckets).alias("b")).distinct().collect()]  # as many as buckets at most
        return (log.where(F.col("_bucket").isin(own)) if len(own) < buckets else log).drop("_bucket")

    def data_of(self, table: str, commits: list[dict]) -> list[str]:
        out: list[str] = []
        for c in commits:
            if table in c.get("compacted", {}):
                out = list(c["compacted"][table])
            out += [x for x in c.get("tables", {}).get(table, {}).get("data", ()) if x.startswith("tables/")]
        return out

    def log(self, table: str, commits: list[dict] | None = None, bucket: bool = False) -> DataFrame:
        """Every belief about a table, as of one list of commits."""
        commits = self.commits() if commits is None else commits
        df = self._read(self.data_of(table, commits), self.config(table, commits))
        return df if bucket else df.drop("_bucket")

    def compact(self, table: str, buckets: int | None = None) -> dict:
        """One sorted folder in place of many, so that reads list and open fewer files; no belief is dropped, and the old folders stay for older readers.

        The table gets as many buckets as are asked for, else more where BUCKET_BYTES asks for more.
        """
        commits = self.commits()
        cfg = self.config(table, commits)
        txn, tx = self._next(commits)
        to = f"tables/{table}/versions/txn={txn:020d}"
        size = sum(n for x in self.data_of(table, commits) for _, n in self.files.files(x))
        buckets = buckets or max(self.buckets(table, commits), -(-size // BUCKET_BYTES))
        self._put(self.log(table, commits).withColumn("_bucket", self._bucket(cfg, buckets)), cfg, buckets, to)
        return self._commit({"type": "compact", "txn_id": txn, "tx_time": tx, "compacted": {table: [to]}, "buckets": {table: buckets}, "tables": {}, "data": [to]})

    def backfill(self, load_id: str, table: str, rows: DataFrame, metadata: dict | None = None) -> dict:
        """The first load of an empty table; the same path as any batch, so all policies hold."""
        commits = self.commits()
        if self.data_of(table, commits) and not any(c.get("load_id") == load_id for c in commits):
            raise EngineError(f"{table} has versions already")
        return self.apply(load_id, [Batch(table, rows)], metadata)

    # Reading.

    def _state(self, table: str, tx: int | None = None, bucket: bool = False, commits: list[dict] | None = None) -> tuple[DataFrame, TableConfig]:
        commits = self.commits() if commits is None else commits
        cfg = self.config(table, commits)
        # Whole transactions that a transaction time excludes are not even opened.
        if tx is not None and not any("compacted" in c for c in commits):
            commits = [c for c in commits if c["tx_time"] <= tx]
            log = self._read(self.data_of(table, commits), cfg)
            return log if bucket else log.drop("_bucket"), cfg
        return self.log(table, commits, bucket), cfg

    def _one(self, rows: DataFrame) -> dict | None:
        found = rows.limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def _keyed(self, table: str, key: dict, tx: int | None = None) -> tuple[DataFrame, TableConfig]:
        """One entity's rows: only the folders of its bucket are opened."""
        commits = self.commits()
        log, cfg = self._state(table, tx, True, commits)
        if set(key) != set(cfg.business_key):
            raise ConfigError(f"a key names {', '.join(cfg.business_key)}")
        # Zeros of both signs are equal, but not as text, which buckets are made of.
        if not any(isinstance(cfg.types[c], T.DoubleType | T.FloatType) for c in cfg.business_key):
            log = log.where(F.col("_bucket") == self._bucket(cfg, self.buckets(table, commits), {c: F.lit(v).cast(cfg.types[c]) for c, v in key.items()}))
        return reads.by_key(log.drop("_bucket"), **{c: F.lit(v).cast(cfg.types[c]) for c, v in key.items()}), cfg

    def get_current(self, table: str, **key) -> dict | None:
        own, cfg = self._keyed(table, key)
        return self._one(reads.current(own, cfg))

    def get_as_of(self, table: str, valid_time, tx_micros: int | None = None, **key) -> dict | None:
        own, cfg = self._keyed(table, key, tx_micros)
        tx = F.timestamp_micros(F.lit(tx_micros)) if tx_micros is not None else None
        return self._one(reads.with_current(reads.as_of(own, cfg, valid_time, tx), tx))

    def get_history(self, table: str, **key) -> list[dict]:
        own, cfg = self._keyed(table, key)
        return [r.asDict(recursive=True) for r in reads.history(own, cfg).orderBy(F.desc("_valid_from"), F.desc("_tx")).collect()]

    def scan_current(self, table: str) -> DataFrame:
        log, cfg = self._state(table)
        return reads.current(log, cfg)

    def scan_as_of(self, table: str, valid_time, tx_micros: int | None = None) -> DataFrame:
        log, cfg = self._state(table, tx_micros)
        tx = F.timestamp_micros(F.lit(tx_micros)) if tx_micros is not None else None
        return reads.with_current(reads.as_of(log, cfg, valid_time, tx), tx)

    def scan_prefix(self, table: str, valid_time=None, **key) -> DataFrame:
        """Entities whose first key columns have these values, in order of the key: as of a valid time, or now."""
        log, cfg = self._state(table)
        own = reads.by_prefix(log, cfg, **{c: F.lit(v).cast(cfg.types[c]) for c, v in key.items()})
        found = reads.current(own, cfg) if valid_time is None else reads.as_of(own, cfg, valid_time)
        return found.orderBy(*cfg.business_key)

    def export(self, rows: DataFrame, table: str, to: str, kind: str = "json") -> None:
        """rows of a table as files: parquet as they are, JSON Lines with values in their printed form, CSV with the schema's columns and _valid_from."""
        if kind != "parquet":
            rows = rows.select(*[render(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])
        if kind == "csv":
            cfg = self.config(table)
            nested = T.ArrayType | T.MapType | T.StructType
            rows = rows.select(*[F.to_json(c).alias(c) if isinstance(cfg.types[c], nested) else F.col(c) for c in cfg.names], "_valid_from")
            rows.write.option("header", "true").option("escape", '"').csv(to)
        else:
            rows.write.format(kind).save(to)

    def manifest(self, load_id: str) -> dict | None:
        return next((c for c in self.commits() if c.get("load_id") == load_id), None)

    def manifests(self, table: str | None = None, limit: int = 100) -> list[dict]:
        """The newest first."""
        own = [c for c in self.commits() if c["type"] == "data" and (table is None or table in c["tables"])]
        return own[::-1][:limit]

    # Quarantine.

    def quarantine(self, table: str) -> DataFrame:
        """Rows that are still diverted, by id."""
        commits = self.commits()
        names = [x for c in commits for x in c.get("tables", {}).get(table, {}).get("data", ()) if x.startswith("quarantine/")]
        schema = "id string, reason string, raw map<string,string>, _delete boolean, _override timestamp, at timestamp"
        df = self.spark.read.schema(schema).parquet(*map(self.files.at, names)) if names else self.spark.createDataFrame([], schema)
        done = [x for c in commits for x in c.get("tables", {}).get(table, {}).get("data", ()) if x.startswith("resolved/")]
        return df.join(self.spark.read.schema("id string").parquet(*map(self.files.at, done)).distinct(), "id", "left_anti") if done else df

    def reapply(self, table: str, load_id: str, ids: list[str] | None = None) -> dict:
        """Applies diverted rows again under a new load id; the ones that now pass are resolved in the same transaction, and those that fail again stay as they are."""
        from ..operators.stage import from_raw

        cfg, rows = self.config(table), self.quarantine(table)
        if ids is not None:
            rows = rows.join(F.broadcast(self.spark.createDataFrame([(i,) for i in ids], "id string").distinct()), "id", "left_semi")  # the caller holds these
        raw = from_raw(rows.select("raw", "_delete", "_override", F.col("id").alias("_ord")), cfg)
        _, tx = self._next(self.commits())
        work = f"staging/{uuid.uuid4().hex}"
        judged = stage(raw, cfg, F.timestamp_micros(F.lit(tx)))
        sound = self._written(judged.where("_reason is null").select(F.col("_ord").alias("id")), work)
        try:
            return self.apply(load_id, [Batch(table, raw.join(sound.withColumnRenamed("id", "_ord"), "_ord", "left_semi"))], {"reapplied": sound.count()}, {table: sound})
        finally:
            self.files.delete(work)

    # Checks.

    def verify(self) -> dict:
        commits, out = self.commits(), {}
        for t, cfg in self.tables(commits).items():
            log = self.log(t, commits)
            out[t] = reads.verify_counts(log, cfg).first().asDict() | {"fingerprint": reads.fingerprint(log)}
        return {"txn_id": len(commits), "tables": out}

    def stats(self) -> dict:
        commits = self.commits()
        files = self.files.files("tables")
        total = {k: sum(p.get(k, 0) for c in commits for p in c.get("tables", {}).values()) for k in COUNTERS}
        lag = {}
        for t, cfg in self.tables(commits).items():
            if cfg.publish_location:
                there = [n for n in Files(self.spark, cfg.publish_location).names("_commit_log") if n.endswith(".json") and not n.startswith(".")]
                done = Files(self.spark, cfg.publish_location).json("_commit_log", there[-1])["txn_to"] if there else 0
                lag[t] = sum(1 for c in commits if c["txn_id"] > done and t in c.get("tables", {}))
        return {"publish_lag": lag, "transactions": len(commits), "tables": len(self.tables(commits)), "files": len(files), "bytes": sum(n for _, n in files)} | total

