"""DuckDB SQL for the queries: the same algebra as common table expressions, one set a batch."""

from __future__ import annotations

from .queries import AS_OF, PERIODS


def _columns(cols: list[str], form: str) -> str:
    return ", ".join(form.format(c=c) for c in cols)


def chain(batches: list[str], key: list[str], cols: list[str], tracked: list[str], late: str = "split", deletes: str = "soft", dups: str = "last_wins") -> str:
    """CTEs that end in `log` (key, vf, vt, op, cols, tx); a batch is a SELECT of key, vf, ord, del, cols. Also p<n> (deduped rows, with mx and fate) and v<n> (survivors)."""
    k = ", ".join(key)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key)
    same = lambda a, b: " AND ".join(f"{a}{c} IS NOT DISTINCT FROM {b}{c}" for c in tracked)
    out = [f"log0 AS (SELECT {_columns(key + cols, '{c}')}, vf, CAST(NULL AS TIMESTAMP) AS vt, CAST(NULL AS VARCHAR) AS op, 0 AS tx FROM ({batches[0]}) WHERE false)"]
    for n, batch in enumerate(batches, 1):
        order = "ASC" if dups == "reject" else "DESC"
        late_sql = f"WHEN vf < mx THEN 'late_{late}'" if late != "split" else ""
        ignore = "WHEN del THEN 'ignored'" if deletes == "ignore" else ""
        out += [
            f"c{n} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {k}, vf ORDER BY tx DESC) AS rn FROM log{n - 1}) WHERE rn = 1)",
            f"m{n} AS (SELECT {k}, max(vf) AS mx FROM c{n} GROUP BY {k})",
            f"p{n} AS (SELECT *, CASE WHEN rn > 1 THEN '{'dup_reject' if dups == 'reject' else 'dup'}' {late_sql} {ignore} ELSE 'live' END AS fate FROM "
            f"(SELECT b.*, m.mx, row_number() OVER (PARTITION BY {', '.join('b.' + c for c in key)}, b.vf ORDER BY b.ord {order}) AS rn FROM ({batch}) b LEFT JOIN m{n} m ON {on('b', 'm')}))",
            f"e{n} AS (SELECT {_columns(key, 'coalesce(p.{c}, c.{c}) AS {c}')}, coalesce(p.vf, c.vf) AS vf, c.vf IS NOT NULL AS has_s, p.vf IS NOT NULL AS has_p, coalesce(p.del, false) AS del, c.op AS s_op, c.vt AS s_vt, "
            f"coalesce(p.vf < p.mx, false) AS late, {_columns(cols, 'p.{c} AS p_{c}, c.{c} AS s_{c}')} FROM c{n} c FULL JOIN (SELECT * FROM p{n} WHERE fate = 'live') p ON {on('p', 'c')} AND p.vf = c.vf)",
            f"d{n} AS (SELECT *, CASE WHEN has_p THEN del ELSE s_op = 'DELETE' END AS dead, {_columns(cols, 'CASE WHEN has_p AND NOT del THEN p_{c} ELSE s_{c} END AS t_{c}')} FROM e{n})",
            f"l{n} AS (SELECT *, lag(dead) OVER w AS prev_dead, {_columns(cols, 'lag(t_{c}) OVER w AS l_{c}')} FROM d{n} WINDOW w AS (PARTITION BY {k} ORDER BY vf))",
            f"n{n} AS (SELECT *, CASE WHEN NOT has_p THEN true WHEN del THEN CASE WHEN has_s THEN s_op = 'DELETE' ELSE coalesce(prev_dead, true) END WHEN has_s AND s_op <> 'DELETE' THEN {same('p_', 's_')} "
            f"WHEN has_s THEN false ELSE NOT coalesce(prev_dead, true) AND {same('p_', 'l_')} END AS no_op FROM l{n})",
            f"s{n} AS (SELECT *, {_columns(cols, 'CASE WHEN NOT no_op AND NOT del THEN p_{c} ELSE s_{c} END AS g_{c}')} FROM n{n} WHERE has_s OR NOT no_op)",
            f"v{n} AS (SELECT *, CASE WHEN no_op THEN s_op WHEN del THEN 'DELETE' WHEN coalesce(lag(dead) OVER w, true) THEN 'INSERT' ELSE 'UPDATE' END AS op, coalesce(lead(vf) OVER w, s_vt) AS vt, "
            f"{_columns(cols, 'CASE WHEN NOT no_op AND del AND NOT has_s THEN lag(g_{c}) OVER w ELSE g_{c} END AS {c}')} FROM s{n} WINDOW w AS (PARTITION BY {k} ORDER BY vf))",
            f"log{n} AS (SELECT {_columns(key + cols, '{c}')}, vf, vt, op, tx FROM log{n - 1} UNION ALL SELECT {_columns(key + cols, '{c}')}, vf, vt, op, {n} AS tx FROM v{n} WHERE NOT no_op OR vt IS DISTINCT FROM s_vt)",
        ]
    return "WITH " + ",\n".join([*out, f"log AS (SELECT * FROM log{len(batches)})"])


def _orders(of: int = 1) -> list[str]:
    whole = "SELECT o_custkey, o_orderdate AS vf, o_orderkey AS ord, false AS del, o_orderstatus, o_orderpriority FROM orders"
    return [whole] if of == 1 else [f"{whole} WHERE o_orderkey * {of} // ((SELECT max(o_orderkey) FROM orders) + 1) = {n}" for n in range(of)]


ORDER_COLUMNS, EVENT_COLUMNS = ["o_orderstatus", "o_orderpriority"], ["event_type", "value"]
EVENT_ROWS = "SELECT user_id, ts AS vf, event_id AS ord, event_type = 'error' AS del, event_type, value FROM events"
CHAIN = "o_custkey, o_orderstatus, o_orderpriority, vf AS valid_from, vt AS valid_to, op"
EVENT_CHAIN = "user_id, event_type, value, vf AS valid_from, vt AS valid_to, op"


def orders(of: int = 1, **how) -> str:
    return chain(_orders(of), ["o_custkey"], ORDER_COLUMNS, ORDER_COLUMNS, **how)


def events(**how) -> str:
    return chain([EVENT_ROWS], ["user_id"], EVENT_COLUMNS, EVENT_COLUMNS, **how)


def _newest(of: str, by: str, where: str = "true") -> str:
    return f"(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY vf DESC, tx DESC) AS n FROM {of} WHERE {where}) WHERE n = 1)"


ALIVE = "op <> 'DELETE' AND (vt IS NULL OR TIMESTAMP '{at}' < vt)"
CURRENT = "op <> 'DELETE' AND vt IS NULL"


def _asof(tx: int | None = None) -> str:
    known = f"vf <= TIMESTAMP '{AS_OF}'" + (f" AND tx <= {tx}" if tx else "")
    return f"{_newest('log', 'o_custkey', known)} WHERE {ALIVE.format(at=AS_OF)}"


def _counts(**how) -> str:
    return (
        orders(2, **how) + " SELECT what, count(*) AS n, CAST(sum(late) AS BIGINT) AS late_splits FROM (SELECT CASE WHEN del THEN 'delete' WHEN has_s OR op = 'UPDATE' THEN 'update' ELSE 'insert' END AS what, CAST(late AS INT) AS late "
        "FROM v2 WHERE NOT no_op UNION ALL SELECT fate, 0 FROM p2 WHERE fate <> 'live') GROUP BY what"
    )


def _carry() -> str:
    """Carry-forward in a run of one life; a view says nothing of value. The tracked columns are all there are, so no-ops change nothing that is inherited."""
    return """
WITH e AS (SELECT user_id, ts AS vf, event_type, value, event_type = 'error' AS dead, event_type <> 'view' AS said FROM events),
r AS (SELECT *, coalesce(sum(CAST(dead AS INT)) OVER (PARTITION BY user_id ORDER BY vf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
t AS (SELECT *, last_value(CASE WHEN said AND NOT dead THEN struct_pack(v := value) END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY vf ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW).v AS val FROM r),
l AS (SELECT *, lag(dead) OVER w AS pd, lag(event_type) OVER w AS pe, lag(val) OVER w AS pv FROM t WINDOW w AS (PARTITION BY user_id ORDER BY vf)),
s AS (SELECT * FROM l WHERE CASE WHEN dead THEN NOT coalesce(pd, true) ELSE coalesce(pd, true) OR event_type IS DISTINCT FROM pe OR val IS DISTINCT FROM pv END)
SELECT user_id, CASE WHEN dead THEN lag(event_type) OVER w ELSE event_type END AS event_type, CASE WHEN dead THEN lag(val) OVER w ELSE val END AS value, vf AS valid_from, lead(vf) OVER w AS valid_to,
  CASE WHEN dead THEN 'DELETE' WHEN coalesce(lag(dead) OVER w, true) THEN 'INSERT' ELSE 'UPDATE' END AS op FROM s WINDOW w AS (PARTITION BY user_id ORDER BY vf)"""


def _intervals() -> str:
    rows = (
        "SELECT user_id, ts AS vf, event_id AS ord, false AS del, event_type FROM events UNION ALL SELECT user_id, ts + INTERVAL 2 HOUR, event_id, true, event_type FROM "
        "(SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR ts + INTERVAL 2 HOUR < nx"
    )
    return chain([rows], ["user_id"], ["event_type"], ["event_type"]) + " SELECT user_id, event_type, vf AS valid_from, vt AS valid_to, op FROM log"


def _periods() -> str:
    """The rows of one transaction have its time, so those of a customer meet at one instant and the last wins; deletes by absence come from the state before."""
    begin, batches = "0001-01-01", []
    for n, end in enumerate(PERIODS, 1):
        rows = f"SELECT o_custkey, TIMESTAMP '{end}' AS vf, o_orderkey AS ord, false AS del, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '{begin}' AND o_orderdate < TIMESTAMP '{end}'"
        if n > 1:
            rows += (
                f" UNION ALL SELECT o_custkey, TIMESTAMP '{end}', NULL, true, NULL FROM {_newest(f'log{n - 1}', 'o_custkey')} WHERE {CURRENT} "
                f"AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{begin}' AND o_orderdate < TIMESTAMP '{end}')"
            )
        batches.append(rows)
        begin = end
    return chain(batches, ["o_custkey"], ["o_orderstatus"], ["o_orderstatus"]) + " SELECT o_custkey, o_orderstatus, vf AS valid_from, vt AS valid_to, op, tx FROM log"


def _vectors() -> str:
    first = "SELECT vec_id, TIMESTAMP '2024-01-01' AS vf, vec_id AS ord, false AS del, embedding, label FROM embeddings"
    second = "SELECT vec_id, TIMESTAMP '2024-02-01' AS vf, vec_id AS ord, false AS del, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding, label FROM embeddings"
    return chain([first, second], ["vec_id"], ["embedding", "label"], ["embedding", "label"]) + " SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, label, vf AS valid_from, vt AS valid_to, op, tx FROM log"


def _lines() -> str:
    cols = ["l_partkey", "l_quantity", "l_returnflag"]
    rows = "SELECT l_orderkey, l_linenumber, l_shipdate AS vf, (l_partkey, l_quantity, l_returnflag) AS ord, false AS del, l_partkey, l_quantity, l_returnflag FROM lineitem"
    return chain([rows], ["l_orderkey", "l_linenumber"], cols, cols) + f" SELECT l_orderkey, l_linenumber, {', '.join(cols)}, vf AS valid_from, vt AS valid_to, op FROM log"


GATES = """
SELECT c_custkey, CASE WHEN c_custkey IS NULL THEN 'business key column c_custkey is null'
  WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'quality gate failed: c_acctbal between 0 and 9000'
  WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'quality gate failed: c_mktsegment in (BUILDING, ''MACHINERY'', AUTOMOBILE)'
  WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]') THEN 'quality gate failed: c_name matches Customer#[0-9]*[02468]' END AS reason FROM customer"""
PROPS = """
SELECT event_id, k, false AS bad, CASE WHEN k BETWEEN -128 AND 127 THEN CAST(k AS INTEGER) END AS k_tiny, k NOT BETWEEN -128 AND 127 AS tiny_bad,
  CASE WHEN k < 100 THEN k + 0.5 END::DOUBLE AS k_half, k >= 100 AS half_bad, true AS quarter_bad, CASE k WHEN 1 THEN true WHEN 0 THEN false END AS flag, k NOT IN (0, 1) AS flag_bad
FROM (SELECT event_id, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events)"""
STAMPS = "SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('second', ts) AS \"offset\", date_trunc('second', ts) AS local, date_trunc('second', ts) AS micros, date_trunc('day', ts)::TIMESTAMP AS day, CAST(NULL AS TIMESTAMP) AS \"none\" FROM events"
FINAL = f"(SELECT *, coalesce(vt, lead(vf) OVER (PARTITION BY o_custkey ORDER BY vf)) AS ve FROM {_newest('log', 'o_custkey, vf')})"

ORACLE_SQL = {
    "scd2_chain_orders": f"{orders()} SELECT {CHAIN} FROM log",
    "scd2_current_orders": f"{orders()} SELECT {CHAIN} FROM {_newest('log', 'o_custkey')} WHERE {CURRENT}",
    "scd2_asof_orders": f"{orders()} SELECT {CHAIN} FROM {_asof()}",
    "scd2_history_beliefs": f"{orders(3)} SELECT {CHAIN}, tx, row_number() OVER (PARTITION BY o_custkey ORDER BY vf DESC, tx DESC) = 1 AND {CURRENT} AS is_current FROM log",
    "bitemporal_asof": orders(3) + " UNION ALL ".join(f" SELECT {CHAIN}, {tx} AS known_at FROM {_asof(tx)}" for tx in (1, 2, 3)),
    "latest_beliefs": f"{orders(3)} SELECT {CHAIN}, tx FROM {_newest('log', 'o_custkey, vf')}",
    "late_split_counts": _counts(),
    "late_reject_counts": _counts(late="reject"),
    "late_quarantine_rows": f"{orders(2, late='quarantine')} SELECT o_custkey, vf AS valid_from, o_orderstatus, o_orderpriority FROM p2 WHERE fate = 'late_quarantine'",
    "dup_reject": f"{orders(dups='reject')} SELECT fate, o_custkey, vf AS valid_from, ord AS o_orderkey FROM p1 WHERE fate <> 'live'",
    "soft_delete_events": f"{events()} SELECT {EVENT_CHAIN} FROM log",
    "delete_ignore_events": f"{events(deletes='ignore')} SELECT {EVENT_CHAIN} FROM log",
    "reinsert_ops": f"{events()} SELECT op, count(*) AS n, count(DISTINCT user_id) AS users FROM log GROUP BY op",
    "carry_forward_events": _carry(),
    "quality_gates_customer": GATES,
    "coerce_json_props": PROPS,
    "parse_timestamps": STAMPS,
    "full_snapshot_periods": _periods(),
    "interval_import_gaps": _intervals(),
    "composite_key_lineitem": _lines(),
    "nested_tracked_embeddings": _vectors(),
    "publish_bitemporal": f"{orders(2)} SELECT o_custkey, o_orderstatus, o_orderpriority, vf AS _valid_from, vt AS _valid_to, op AS _op, tx FROM log",
    "publish_databricks": f"{events()} SELECT user_id, event_type, value, vf AS __START_AT, vt AS __END_AT, tx FROM log WHERE op <> 'DELETE'",
    "publish_custom": f"{orders()} SELECT o_custkey, o_orderstatus, o_orderpriority, vf AS EFF_START_DT, vt AS EFF_END_DT, tx FROM log WHERE op <> 'DELETE'",
    "finalize_current": f"{orders(3)} SELECT o_custkey, o_orderstatus, o_orderpriority, vf AS valid_from, op FROM {FINAL} WHERE op <> 'DELETE' AND ve IS NULL",
    "verify_counts": f"{orders(2)} SELECT (SELECT count(*) FROM log) AS version_records, count(*) AS entities, count(*) FILTER (WHERE {CURRENT}) AS current_rows FROM {_newest('log', 'o_custkey')}",
    "asof_join_lineitem": f"{orders()} SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o.o_custkey, g.o_orderstatus, g.o_orderpriority, g.vf AS valid_from FROM lineitem JOIN orders o ON l_orderkey = o_orderkey "
    "LEFT JOIN log g ON g.o_custkey = o.o_custkey AND g.op <> 'DELETE' AND l_shipdate >= g.vf AND (g.vt IS NULL OR l_shipdate < g.vt)",
    "multi_get_orders": f"{orders()} SELECT c_custkey AS o_custkey, o_orderstatus, o_orderpriority, vf AS valid_from, vt AS valid_to, op FROM customer LEFT JOIN (SELECT * FROM {_newest('log', 'o_custkey')} WHERE {CURRENT}) g ON g.o_custkey = c_custkey",
    "substring_rows": f"{orders()} SELECT o_custkey, o_orderstatus, o_orderpriority FROM {_newest('log', 'o_custkey')} WHERE {CURRENT} AND (contains(lower(o_orderstatus), 'urgent') OR contains(lower(o_orderpriority), 'urgent'))",
    "page_rows": f"{orders()} SELECT o_custkey, o_orderstatus, o_orderpriority FROM {_newest('log', 'o_custkey')} WHERE {CURRENT} ORDER BY o_custkey LIMIT 10 OFFSET 20",
    "publish_partitions": f"{orders()} SELECT o_orderstatus, op, count(*) AS n FROM log GROUP BY ALL",
}
