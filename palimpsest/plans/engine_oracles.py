"""DuckDB SQL for the queries that go through a database: what the same rows must say, by the algebra of oracles.py or straight from the tables."""

from __future__ import annotations

from .engine_queries import COUNTS, CUSTOMERS, PLACES, SUPPLIERS
from .oracles import ALIVE, CHAIN, CURRENT, FINAL, GATES, ORACLE_SQL as ALGEBRA, ORDER_COLUMNS, _asof, _lines, _newest, _orders, _periods, chain, orders
from .queries import AS_OF

_THREE = orders(3)
_NOW = f"SELECT {CHAIN} FROM {_newest('log', 'o_custkey')} WHERE {CURRENT}"
_KINDS = "CASE WHEN del THEN 'delete' WHEN has_s OR op = 'UPDATE' THEN 'update' ELSE 'insert' END"


def _manifest(n: int) -> str:
    made = lambda kind: f"(SELECT count(*) FROM v{n} WHERE NOT no_op AND {_KINDS} = '{kind}')"
    number = {
        "rows_in": f"(SELECT count(*) FROM p{n})", "inserts": made("insert"), "updates": made("update"), "deletes": made("delete"), "rejects": "0", "quarantined": "0",
        "no_ops": f"(SELECT count(*) FROM p{n} WHERE fate = 'live') - (SELECT count(*) FROM v{n} WHERE NOT no_op)", "late_splits": f"(SELECT count(*) FROM v{n} WHERE NOT no_op AND late)",
    }
    return f"SELECT 'b{n - 1}' AS load_id, " + ", ".join(f"CAST({number[c]} AS BIGINT) AS {c}" for c in COUNTS)


_FINAL_ROWS = f"SELECT o_custkey, o_orderstatus, o_orderpriority, vf AS valid_from, op FROM {FINAL} WHERE op <> 'DELETE' AND ve IS NULL"
_GATED = f"(SELECT c_custkey, reason FROM ({GATES}))"

ORACLE_SQL = {
    **{f"engine_{kind}": ALGEBRA["scd2_current_orders"] for kind in ("jsonl", "csv", "json_arrays")},
    "engine_document": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "engine_envelope": "SELECT n_nationkey, n_name, 7 AS n_regionkey, TIMESTAMP '2020-01-01' AS valid_from, 'one' AS load_id, 'a test' AS by FROM nation",
    "engine_history": ALGEBRA["scd2_history_beliefs"],
    "engine_current": f"{_THREE} {_NOW}",
    "engine_asof": _THREE + " UNION ALL ".join(f" SELECT {CHAIN}, {'vt IS NULL' if not tx else 'false'} AS is_current, {tx} AS known_at FROM {_asof(tx or None)}" for tx in (0, 1, 2, 3)),
    "engine_compacted": f"{_THREE} SELECT {CHAIN}, tx FROM log",
    "engine_manifests": _THREE + " UNION ALL ".join(f" {_manifest(n)}" for n in (1, 2, 3)),
    "engine_replay": f"{_THREE} SELECT 'b' || i AS load_id, true AS same, true AS refused, CAST(4 AS BIGINT) AS commits, (SELECT count(*) FROM log) AS versions FROM range(3) t(i)",
    "engine_multi_table": "SELECT 'customers' AS t, c_custkey AS k, c_name AS name, CAST(3 AS BIGINT) AS txn FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_name, 3 FROM supplier",
    "engine_skipped": f"SELECT c_custkey, (SELECT count(*) FROM {_GATED} WHERE reason IS NOT NULL) AS rejects, (SELECT count(*) FROM {_GATED} WHERE reason IS NULL) AS inserts FROM {_GATED} WHERE reason IS NULL",
    "engine_quarantined": f"SELECT c_custkey, reason FROM {_GATED} WHERE reason IS NOT NULL",
    "engine_reapplied": f"SELECT c_custkey, CASE WHEN reason IS NULL OR c_acctbal BETWEEN 0 AND 9000 THEN 'table' ELSE 'quarantine' END AS at, "
    f"(SELECT count(*) FROM {_GATED} JOIN customer USING (c_custkey) WHERE reason IS NOT NULL AND c_acctbal BETWEEN 0 AND 9000) AS taken FROM {_GATED} JOIN customer USING (c_custkey)",
    "engine_late_quarantine": ALGEBRA["late_quarantine_rows"],
    "engine_grown": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 1 THEN 2 ELSE 1 END AS schema_version, CASE WHEN c_custkey % 2 = 1 THEN 'UPDATE' ELSE 'INSERT' END AS op FROM customer",
    "engine_snapshots": f"SELECT o_custkey, o_orderstatus, op, tx, valid_to IS NULL AS is_open FROM ({_periods()})",
    "engine_intervals": ALGEBRA["interval_import_gaps"],
    "engine_published": ALGEBRA["publish_bitemporal"],
    "engine_finalized": f"{_THREE} {_FINAL_ROWS}",
    "engine_partitions": f"{orders(2)} SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM log GROUP BY ALL",
    "engine_view": f"{_THREE} {_FINAL_ROWS}",
    "engine_restored": f"{chain(_orders(3)[:2], ['o_custkey'], ORDER_COLUMNS, ORDER_COLUMNS)} SELECT {CHAIN}, tx FROM log",
    "engine_changes": f"{_THREE} SELECT {CHAIN}, tx FROM log WHERE tx = 3",
    "engine_stream": "SELECT DISTINCT o_custkey FROM orders",
    "engine_verified": f"{_THREE} SELECT (SELECT count(*) FROM log) AS version_records, count(*) AS entities, count(*) FILTER (WHERE {CURRENT}) AS current_rows FROM {_newest('log', 'o_custkey')}",
    "engine_prefix": f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, op FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY valid_from DESC) AS rn FROM ({_lines()})) "
    "WHERE rn = 1 AND valid_to IS NULL AND op <> 'DELETE' AND l_orderkey = (SELECT min(l_orderkey) FROM lineitem)",
    "engine_points": f"{_THREE} SELECT CAST(k AS BIGINT) AS k, n.o_orderstatus AS status, n.o_orderpriority AS priority, t.o_orderstatus AS status_then, (SELECT count(*) FROM log WHERE o_custkey = k) AS versions FROM range(1, 6) r(k) "
    f"LEFT JOIN (SELECT * FROM {_newest('log', 'o_custkey')} WHERE {CURRENT}) n ON n.o_custkey = k LEFT JOIN (SELECT * FROM {_newest('log', 'o_custkey', f"vf <= TIMESTAMP '{AS_OF}'")} WHERE {ALIVE.format(at=AS_OF)}) t ON t.o_custkey = k",
    "engine_export": f"{_THREE} SELECT o_custkey, o_orderstatus, o_orderpriority, strftime(valid_from, '%Y-%m-%dT%H:%M:%S.%fZ') AS valid_from, op FROM ({_NOW})",
    "engine_hooks": "SELECT CAST(txn AS BIGINT) AS txn, type, load_id FROM (VALUES (2, 'data', 'b0'), (3, 'data', 'b1'), (4, 'compact', NULL)) v(txn, type, load_id)",
    "engine_files": "SELECT 'txn=0000000000000000000' || n AS name FROM (VALUES (2), (3)) v(n)",
    "engine_types": "SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance, c_name AS code, day, TIMESTAMP '2001-02-03 03:05:00' + to_seconds(c_custkey % 60) AS seen, c_custkey % 2 = 0 AS good, CAST(c_custkey % 100 AS INT) AS small, "
    "c_mktsegment AS tag, c_name AS city, CAST(c_custkey % 7 AS INT) AS nr, c_custkey AS most FROM (SELECT *, DATE '1997-01-01' + CAST(c_custkey % 1000 AS INT) AS day FROM customer) WHERE day - DATE '1970-01-01' BETWEEN 10000 AND 10500",
    "engine_null_keys": "SELECT s_nationkey, s_suppkey, s_name, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0 OR length(s_name) <= 3) AS rejects FROM supplier WHERE s_suppkey % 3 <> 0 AND length(s_name) > 3",
    "engine_load_ids": "SELECT numeric, id, CASE WHEN trim(id) = '' OR id = repeat('x', 20) THEN false ELSE NOT numeric OR id IN ('17', '9223372036854775807') END AS taken FROM (VALUES (true), (false)) n(numeric), "
    "(VALUES ('abc'), ('run-1'), ('-5'), ('0'), ('1.5'), ('99999999999999999999'), (''), (' '), ('17'), ('9223372036854775807'), (repeat('x', 20))) v(id)",
    "engine_formats": "SELECT kind, n_nationkey, n_name, n_regionkey, 'INSERT' AS op FROM nation, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) v(kind)",
    "engine_csv_quotes": "SELECT c_custkey, c_name || ', \"quoted\"' || chr(10) || c_mktsegment || ' é' AS name FROM customer",
    "engine_failed_batch": "SELECT count(*) AS n, 'refused,done,refused' AS said, CAST(3 AS BIGINT) AS commits, CAST(0 AS BIGINT) AS left FROM customer",
    "engine_described": "SELECT * FROM (VALUES " + ", ".join(f"('{t.table}', '{n}', '{kind}', {n in t.business_key})" for t in (CUSTOMERS, SUPPLIERS, *PLACES) for n, kind in t.columns) + ") v(t, name, kind, is_key)",
    "engine_stats": f"{_THREE}, counts AS (" + " UNION ALL ".join(_manifest(n) for n in (1, 2, 3)) + ") SELECT CAST(4 AS BIGINT) AS transactions, CAST(1 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS lag, "
    "CAST(sum(rows_in) AS BIGINT) AS rows_in, CAST(sum(inserts) AS BIGINT) AS inserts, CAST(sum(updates) AS BIGINT) AS updates FROM counts",
    "engine_snapshot_copy": f"{orders(2)} SELECT *, CAST(0 AS BIGINT) AS there FROM ({_NOW})",
    "engine_stream_twice": "SELECT count(DISTINCT o_custkey) AS current_rows, count(*) AS rows_in, CAST(2 AS BIGINT) AS transactions FROM orders",
    "engine_change_stream": f"{_THREE} SELECT {CHAIN}, tx FROM log",
    "engine_commands": "SELECT * FROM (VALUES ('apply', 0, (SELECT CAST(count(*) AS VARCHAR) FROM nation)), ('again', 0, '2'), ('get', 0, (SELECT n_name FROM nation WHERE n_nationkey = 3)), ('none', 0, NULL), ('history', 0, '1'), "
    "('bad key', 2, NULL), ('other table', 1, NULL), ('scan', 0, (SELECT CAST(count(*) AS VARCHAR) FROM nation)), ('list', 0, 'nation'), ('compact', 0, 'compact')) v(command, code, answer)",
}
