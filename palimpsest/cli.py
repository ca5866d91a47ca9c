"""A thin command line over the engine. Exit codes: 0 done, 1 refused by the engine, 2 usage or declaration, 3 not found."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.intervals import from_intervals
from .operators.publish import Publisher
from .operators.stage import from_raw
from .plans import archive
from .plans.config import ConfigError, from_yaml
from .plans.runid import RunIds
from .plans.store import Batch, Engine, EngineError, Options
from .sources import readers


def session() -> SparkSession:
    return SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def staged(raw, cfg):
    """Typed rows; rows with interval columns become changes."""
    from pyspark.sql import functions as F

    from .functions.coerce import parse_timestamp

    start, end = "__START_AT", "__END_AT"
    has = raw.where(F.map_contains_key("raw", start)).limit(1).count() > 0
    rows = from_raw(raw, cfg)
    if not has:
        return rows
    timed = rows.withColumns({"_start": parse_timestamp(F.element_at("_raw", start)), "_end": parse_timestamp(F.element_at("_raw", end))})
    return from_intervals(timed, cfg)


def load(engine: Engine, given: readers.Input, table: str | None, load_id: str | None, snapshot: bool, effective: str | None, backfill: bool = False) -> dict:
    batches = []
    for name, raw in given.rows.items():
        to = table or name
        if not to:
            raise ConfigError("name a table")
        at = readers.instant(effective or given.effective_at)
        batches.append(Batch(to, staged(raw, engine.config(to)), snapshot, at))
    use = readers.resolve_load_id(load_id, given.load_id)
    if not use:
        raise ConfigError("a load id is needed, as a flag or in the envelope")
    if backfill and len(batches) == 1:
        return engine.backfill(use, batches[0].table, batches[0].rows, given.metadata)
    return engine.apply(use, batches, given.metadata)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("palimpsest")
    p.add_argument("--db", required=False)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *[c.add_argument(*([a] if isinstance(a, str) else a[:-1]), **({} if isinstance(a, str) else a[-1])) for a in args]][0]
    flag = {"action": "store_true"}
    add("init")
    add("table", ("action", {"choices": ["create", "alter", "list", "describe"]}), ("what", {"nargs": "?"}))
    for name in ("load", "apply"):
        add(name, ("file", {}), ("--table", {}), ("--format", {"choices": ["csv", "json", "jsonl"]}), ("--load-id", {}), ("--full-snapshot", flag), ("--effective-at", {}))
    for name in ("get", "asof", "history"):
        add(name, "table", ("key", {"nargs": "+"}), ("--valid", {}), ("--tx", {"type": int}))
    add("scan", "table", ("--valid", {}), ("--tx", {"type": int}), ("--format", {"choices": ["csv", "json", "parquet"], "default": "json"}), ("--out", "-o", {}))
    for name in ("export-status", "publish", "finalize"):
        add(name, "table", ("--location", {}))
    add("snapshot", "target")
    add("ship", "target")
    add("restore", "archive", ("--as-of-txn", {"type": int}))
    add("vacuum")
    add("unlock")
    add("compact", "table")
    add("verify")
    add("manifest", ("action", {"choices": ["show", "list"]}), ("what", {"nargs": "?"}), ("--limit", {"type": int, "default": 20}))
    add("quarantine", ("action", {"choices": ["list", "reapply"]}), "table", ("--id", {"action": "append"}), ("--load-id", {}), ("--limit", {"type": int, "default": 100}))
    add("stats")
    add("serve", ("--port", {"type": int, "default": 8080}))
    add("run-id")
    return p


def run(args: argparse.Namespace, spark: SparkSession | None = None):
    """What a command prints."""
    if args.command == "run-id":
        return RunIds().next()
    spark = spark or session()
    if not args.db:
        raise ConfigError("--db is needed")
    if args.command == "unlock":
        e = Engine(spark, args.db, read_only=True)
        e.unlock()
        return {"unlocked": args.db}
    if args.command == "restore":
        return archive.restore(spark, args.archive, args.db, args.as_of_txn)
    reading = args.command in ("get", "asof", "history", "scan", "verify", "manifest", "stats", "export-status") or args.command == "table" and args.action in ("list", "describe") or args.command == "quarantine" and args.action == "list"
    with Engine(spark, args.db, Options(), read_only=reading) as e:
        match args.command:
            case "init":
                return {"db": args.db}
            case "table" if args.action in ("create", "alter"):
                cfg = from_yaml(open(args.what).read())  # noqa: SIM115
                return (e.create_table if args.action == "create" else e.alter_table)(cfg)
            case "table" if args.action == "list":
                return list(e.tables())
            case "table":
                return e.config(args.what).to_dict()
            case "load" | "apply":
                given = readers.read_string(spark, sys.stdin.read(), args.format or "jsonl") if args.file == "-" else readers.read(spark, args.file, args.format)
                return load(e, given, args.table, args.load_id, args.full_snapshot, args.effective_at, args.command == "load")
            case "get":
                return e.get_current(args.table, **readers.parse_key(args.key))
            case "asof":
                return e.get_as_of(args.table, args.valid or "9999-01-01", args.tx, **readers.parse_key(args.key))
            case "history":
                return e.get_history(args.table, **readers.parse_key(args.key)) or None
            case "scan":
                df = e.scan_as_of(args.table, args.valid, args.tx) if args.valid else e.scan_current(args.table)
                if args.out:
                    e.export(df, args.table, args.out, args.format)
                    return {"out": args.out}
                return (r.asDict(recursive=True) for r in df.toLocalIterator())
            case "publish":
                return Publisher(e, args.table, args.location).publish() or {}
            case "finalize":
                p = Publisher(e, args.table, args.location)
                p.publish()
                return p.finalize()
            case "export-status":
                p = Publisher(e, args.table, args.location)
                return {"watermark": p.watermark, "behind": len(e.commits()) - p.watermark}
            case "snapshot":
                return archive.snapshot(e, args.target)
            case "ship":
                return archive.ship(e, args.target)
            case "vacuum":
                archive.vacuum(e)
                return {}
            case "compact":
                return e.compact(args.table)
            case "verify":
                return e.verify()
            case "stats":
                return e.stats()
            case "serve":
                from .server import serve

                serve(e, args.port).serve_forever()
            case "manifest":
                return e.manifest(args.what) if args.action == "show" else e.manifests(args.what, args.limit)
            case "quarantine" if args.action == "reapply":
                return e.reapply(args.table, args.load_id, args.id)
            case "quarantine":
                return [r.asDict(recursive=True) for r in e.quarantine(args.table).orderBy("id").limit(args.limit).collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        out = run(args, spark)
        if out is None:
            print("not found", file=sys.stderr)
            return 3
        for line in out if not isinstance(out, dict | list | str | int) else [out]:
            print(json.dumps(line, default=str))
        return 0
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    except (EngineError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
