"""Random batches: the windows against the fold, in emitted rows, counters and reads at random points of both clocks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.decide import decide, touched
from palimpsest.operators.reads import as_of, current, latest
from palimpsest.plans.config import TableConfig

from .oracle import fold_batch

COLUMNS = ("a", "b", "ig")
SCHEMA = "seed int, id int, a string, b string, ig string, _valid_from timestamp, _delete boolean, _absent array<string>, _ord long"


def at(n):
    return f"2024-01-01T00:{n // 60:02d}:{n % 60:02d}"


def make(seed, carry):
    rng = random.Random(seed)
    batches = []
    for _ in range(3):
        rows = []
        for _ in range(rng.randrange(1, 9)):
            values = {c: rng.choice(["x", "y", None]) for c in COLUMNS if not carry or rng.random() < 0.6}
            rows.append({"key": (seed, rng.randrange(2)), "vf": rng.randrange(9), "delete": rng.random() < 0.25, "values": values})
        batches.append(rows)
    return batches


@pytest.mark.parametrize("late,dups,deletes,carry", [("split", "last_wins", "soft", True), ("split", "last_wins", "soft", False), ("reject", "reject", "soft", False), ("quarantine", "last_wins", "ignore", True), ("split", "reject", "ignore", True), ("reject", "last_wins", "soft", True)])
def test_windows_equal_fold(spark, late, dups, deletes, carry):
    cfg = TableConfig("t", ("seed", "id"), (("seed", "int"), ("id", "int"), ("a", "string"), ("b", "string"), ("ig", "string")), ignored_columns=("ig",), late_policy=late, same_batch_duplicates=dups, deletes=deletes, absent_columns="carry_forward" if carry else "null")
    seeds = range(150)
    plans = {s: make(s, carry) for s in seeds}
    chains, log = {}, None
    for tx in range(3):
        rows = [r for s in seeds for r in plans[s][tx]]
        for r in rows:
            if not carry:
                r["values"] = {c: r["values"].get(c) for c in COLUMNS}
        emitted, counters = fold_batch(chains, rows, late=late, dups=dups, deletes=deletes, carry=carry, tracked=("a", "b"), columns=COLUMNS)
        pending = spark.createDataFrame([(*r["key"], *(r["values"].get(c) for c in COLUMNS), None, r["delete"], [c for c in COLUMNS if c not in r["values"]] if carry and not r["delete"] else [], n) for n, r in enumerate(rows)], SCHEMA)
        pending = pending.drop("_valid_from").join(spark.createDataFrame([(n, at(r["vf"])) for n, r in enumerate(rows)], "_ord long, t string"), "_ord").withColumn("_valid_from", F.col("t").cast("timestamp")).drop("t")
        empty = spark.createDataFrame([], cfg.schema.add("_valid_from", "timestamp").add("_valid_to", "timestamp").add("_op", "string"))
        changes, refused = decide(empty if log is None else touched(latest(log, cfg), pending, cfg), pending, cfg)
        got = changes.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in ("_valid_from", "_valid_to")}).collect()
        full = changes.collect()
        mine = sorted(((r.seed, r.id), r._valid_from, r._valid_to, r._op, (r.a, r.b, r.ig)) for r in got)
        theirs = sorted((k, at(vf), at(vt) if vt is not None else None, op, row) for k, vf, vt, op, row in emitted)
        assert sorted(map(repr, mine)) == sorted(map(repr, theirs))
        fates = Counter({r._fate: r["count"] for r in refused.groupBy("_fate").count().collect()})
        outcomes = Counter(r._outcome for r in got)
        assert outcomes["insert"] == counters["inserts"] and outcomes["update"] == counters["updates"] and outcomes["delete"] == counters["deletes"]
        assert sum(r._late for r in got) == counters["late_splits"]
        assert fates["dup_reject"] + fates["late_reject"] == counters["rejects"] and fates["late_quarantine"] == counters["quarantined"]
        fresh = outcomes["insert"] + outcomes["update"] + outcomes["delete"]
        assert len(rows) - fates["dup"] - counters["rejects"] - counters["quarantined"] - fresh == counters["no_ops"]
        new = spark.createDataFrame([r.asDict() | {"_tx": tx} for r in full], changes.schema.add("_tx", "integer")).drop("_outcome", "_late")
        log = new if log is None else log.unionByName(new)
    now = {(r.seed, r.id): (r.a, r.b, r.ig) for r in current(log, cfg).collect()}
    assert now == {k: tuple(c[-1]["row"].get(x) for x in COLUMNS) for k, c in chains.items() if c and c[-1]["op"] != "DELETE" and c[-1]["vt"] is None}
    for t in (0, 3, 7):
        found = {(r.seed, r.id): (r.a, r.b, r.ig) for r in as_of(log, cfg, at(t)).collect()}
        want = {}
        for k, c in chains.items():
            v = [v for v in c if v["vf"] <= t]
            if v and v[-1]["op"] != "DELETE" and (v[-1]["vt"] is None or t < v[-1]["vt"]):
                want[k] = tuple(v[-1]["row"].get(x) for x in COLUMNS)
        assert found == want
