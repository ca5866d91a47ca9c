"""The decision of what a batch changes: one pass of windows over each entity's stored and pending rows, no user-defined functions.

Of stored rows the latest belief of each (key, valid time) counts. The state after an instant depends on what happens at that instant alone, so every question that a row-by-row fold would ask of the
chain (is the predecessor alive, does its payload equal mine, what do absent columns inherit) is a lag or a running last over the entity's rows in order of valid time. All windows and the merge use one
exchange and one sort, by business key and time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import comparable
from ..plans.config import TableConfig

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"


class Decision(NamedTuple):
    #: Versions to write: schema columns, _valid_from, _valid_to, _op, _outcome (insert, update, delete; null for a stored version that is only closed), _late, and the first column of dealt.
    changes: DataFrame
    #: Rows that take no part: _fate (dup, dup_reject, late_reject, late_quarantine, ignored), with the pending row's columns.
    refused: DataFrame


def decide(state: DataFrame, pending: DataFrame, cfg: TableConfig, dealt: dict[str, Column] | None = None) -> Decision:
    """state: schema columns, _valid_from, _valid_to, _op: the beliefs of the keys that pending names (of others it may hold any or none); with _tx the newest of a key and valid time counts, without it there is one.
    pending: sound staged rows: schema columns, _valid_from, _delete, _absent, _ord.
    dealt: columns made of the key by which rows are dealt instead of the key; changes keep the first of them."""
    key, payload, kinds = list(cfg.business_key), cfg.payload, cfg.types
    fields = [F.col(c) for c in payload]
    tx = F.col("_tx") if "_tx" in state.columns else F.lit(0)
    stored = F.struct(*fields, F.col("_valid_to").alias("_valid_to"), F.col("_op").alias("_op"), tx.alias("_tx"))
    brought = F.struct(*fields, F.col("_delete").alias("_delete"), F.col("_absent").alias("_absent"), F.col("_ord").alias("_ord"))
    both = state.select(*key, "_valid_from", stored.alias("s")).unionByName(pending.select(*key, "_valid_from", brought.alias("p")), allowMissingColumns=True)
    dealt = dealt or {}
    lead = list(dealt)
    both = both.withColumns(dealt).repartition(*lead) if lead else both.repartition(*key)
    # They say no more than the key, but a window by the key and them needs no other exchange; the key comes first, as sorting is fastest by what tells most rows apart.
    own = [*key, *lead]

    split = cfg.late_policy == "split"
    is_stored = F.col("s").isNotNull()
    order = F.col("p._ord").asc() if cfg.same_batch_duplicates == "reject" else F.col("p._ord").desc()
    nth = F.row_number().over(Window.partitionBy(*own, "_valid_from", "_stored").orderBy(F.col("s._tx").desc(), order))
    told = both.withColumns({"_stored": is_stored} | ({} if split else {"_newest": F.max(F.when(is_stored, F.col("_valid_from"))).over(Window.partitionBy(*own))})).withColumn("_nth", nth)
    fate = F.when(F.col("_stored"), F.when(F.col("_nth") > 1, "superseded").otherwise("stored")).when(F.col("_nth") > 1, "dup_reject" if cfg.same_batch_duplicates == "reject" else "dup")
    if not split:
        fate = fate.when(F.col("_valid_from") < F.col("_newest"), f"late_{cfg.late_policy}")
    if cfg.deletes == "ignore":
        fate = fate.when(F.col("p._delete"), "ignored")
    told = told.withColumn("_fate", fate.otherwise("live"))
    refused = told.where(~F.col("_fate").isin("stored", "superseded", "live")).select("_fate", *key, "_valid_from", "p.*")

    live = told.where(F.col("_fate").isin("stored", "live")).groupBy(*own, "_valid_from").agg(F.first("s", ignorenulls=True).alias("s"), F.first("p", ignorenulls=True).alias("p"))
    by_key = Window.partitionBy(*own).orderBy("_valid_from")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    has_s, has_p = F.col("s").isNotNull(), F.col("p").isNotNull()
    s_dead = has_s & (F.col("s._op") == DELETE)
    upsert, delete = has_p & ~F.col("p._delete"), has_p & F.col("p._delete")
    live = live.withColumns({"_upsert": F.coalesce(upsert, F.lit(False)), "_delete": F.coalesce(delete, F.lit(False)), "_s_dead": F.coalesce(s_dead, F.lit(False)), "_s_alive": has_s & F.coalesce(~s_dead, F.lit(False))})
    live = live.withColumn("_dead", F.when(F.col("_upsert"), False).when(F.col("_delete"), True).otherwise(F.col("_s_dead")))
    carry = cfg.absent_columns == "carry_forward"
    chain = {"_prev_alive": F.coalesce(~F.lag("_dead").over(by_key), F.lit(False))}
    # All rows that a batch brings under other policies than split are in time.
    newest = F.max(F.when(has_s, F.col("_valid_from"))).over(by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chain["_late"] = F.coalesce(F.col("_valid_from") < newest, F.lit(False)) if split else F.lit(False)
    if carry:
        # A run is a stretch of one life: it ends with a death, and a row that revives a stored tombstone starts another.
        chain["_run"] = F.coalesce(F.sum(F.col("_dead").cast("int")).over(before), F.lit(0)) + F.sum((F.col("_upsert") & F.col("_s_dead")).cast("int")).over(so_far)

    def in_run(x: Column) -> Column:
        """The last x (a struct or null) of the row's run up to it: runs follow each other, so it is the key's last one, if that is of this run."""
        last = F.last(F.when(x.isNotNull(), F.struct(F.col("_run").alias("run"), x.alias("x"))), ignorenulls=True).over(so_far)
        return F.when(last["run"] == F.col("_run"), last["x"]["v"])

    def brings(c: str) -> Column:
        """What a pending upsert says of a column, in a struct; null if it must be inherited."""
        own = F.struct(F.col(f"p.{c}").alias("v"))
        if not carry:
            return own
        inherited = F.when(F.col("_s_alive"), F.struct(F.col(f"s.{c}").alias("v")))
        return F.when(F.array_contains("p._absent", c), inherited).otherwise(own)

    tracked = cfg.tracked
    alike = lambda value: F.struct(F.lit(0).alias("_"), *[comparable(value(c), kinds[c]).alias(c) for c in tracked])
    if carry:
        live = live.withColumns(chain)
        known = {c: F.when(F.col("_upsert"), brings(c)).when(~F.col("_dead"), F.struct(F.col(f"s.{c}").alias("v"))) for c in tracked}
        live = live.withColumns({f"_t_{c}": in_run(x) for c, x in known.items()}).withColumn("_tracked", alike(lambda c: F.col(f"_t_{c}")))
        live = live.withColumn("_before", F.lag("_tracked").over(by_key))
    else:
        live = live.withColumn("_tracked", alike(lambda c: F.when(F.col("_upsert"), F.col(f"p.{c}")).otherwise(F.col(f"s.{c}"))))
        live = live.withColumns(chain | {"_before": F.lag("_tracked").over(by_key)})
    no_op = (
        F.when(F.col("_delete"), F.when(has_s, F.col("_s_dead")).otherwise(~F.col("_prev_alive")))
        .when(F.col("_upsert") & F.col("_s_alive"), F.col("_tracked").eqNullSafe(alike(lambda c: F.col(f"s.{c}"))))
        .when(F.col("_upsert") & has_s, False)
        .when(F.col("_upsert"), F.col("_prev_alive") & F.col("_tracked").eqNullSafe(F.col("_before")))
        .otherwise(True)
    )
    live = live.withColumn("_fresh", ~no_op).drop(*[f"_t_{c}" for c in tracked], "_tracked", "_before")

    left = live.where(has_s | F.col("_fresh"))
    # Payload: a tombstone has its stored version's, or its predecessor's, which is alive; what an upsert leaves out comes from the run's survivors.
    if carry:
        given = {c: F.when(F.col("_fresh") & F.col("_upsert"), brings(c)).when(has_s, F.struct(F.col(f"s.{c}").alias("v"))) for c in payload}
        values = {c: in_run(x) for c, x in given.items()}
    else:
        whole = lambda at: F.struct(*[F.col(f"{at}.{c}").alias(c) for c in payload], F.lit(0).alias("_"))
        whole = F.last(F.when(F.col("_fresh") & F.col("_upsert"), whole("p")).when(has_s, whole("s")), ignorenulls=True).over(so_far)
        left, values = left.withColumn("_whole", whole), {c: F.col("_whole")[c] for c in payload}
    prev_dead = F.lag("_dead").over(by_key)
    op = F.when(~F.col("_fresh"), F.col("s._op")).when(F.col("_delete"), DELETE).when(F.coalesce(prev_dead, F.lit(True)), INSERT).otherwise(UPDATE)
    left = left.withColumns({**{f"_v_{c}": x for c, x in values.items()}, "_op": op, "_valid_to": F.coalesce(F.lead("_valid_from").over(by_key), F.col("s._valid_to"))})
    written = left.where(F.col("_fresh") | ~F.col("_valid_to").eqNullSafe(F.col("s._valid_to")))
    outcome = F.when(~F.col("_fresh"), F.lit(None)).when(F.col("_delete"), "delete").when(has_s | (F.col("_op") == UPDATE), "update").otherwise("insert")
    columns = [F.col(c) if c in key else F.col(f"_v_{c}").alias(c) for c in cfg.names]
    changes = written.select(*columns, "_valid_from", "_valid_to", "_op", outcome.alias("_outcome"), (F.col("_fresh") & F.col("_late")).alias("_late"), *lead[:1])
    return Decision(changes, refused)


def touched(state: DataFrame, pending: DataFrame, cfg: TableConfig) -> DataFrame:
    """state's rows of the keys that pending names."""
    return state.join(pending.select(*cfg.business_key).distinct(), list(cfg.business_key), "left_semi")


def missing_keys(current: DataFrame, seen: DataFrame, cfg: TableConfig, tx_time: Column) -> DataFrame:
    """A delete for every current entity that a full snapshot does not name; current: R6's rows, seen: the snapshot's keys."""
    gone = current.select(*cfg.business_key).join(seen.select(*cfg.business_key).distinct(), list(cfg.business_key), "left_anti")
    return gone.select(*[(F.col(c) if c in cfg.business_key else F.lit(None)).cast(cfg.types[c]).alias(c) for c in cfg.names], tx_time.alias("_valid_from"), F.lit(True).alias("_delete"), F.expr("cast(array() as array<string>)").alias("_absent"))


def fold(log: DataFrame | None, pending: DataFrame, cfg: TableConfig, tx: int) -> DataFrame:
    """The log of beliefs after one more batch, in memory: schema columns, _valid_from, _valid_to, _op, _tx."""
    empty = pending.sparkSession.createDataFrame([], cfg.schema.add("_valid_from", "timestamp").add("_valid_to", "timestamp").add("_op", "string"))
    state = empty if log is None else touched(log, pending, cfg)
    new = decide(state, pending, cfg).changes.select(*cfg.names, "_valid_from", "_valid_to", "_op", F.lit(tx).alias("_tx"))
    return new if log is None else log.unionByName(new)
