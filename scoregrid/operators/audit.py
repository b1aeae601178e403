"""Audit: targets, eligibility, failure streaks, statuses and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def targets_from_winners(official: DataFrame, watchlist: DataFrame, winners: DataFrame, public: DataFrame) -> DataFrame:
    """(element_id, miner_hotkey, commit_block, origin): the first appearance of a pair counts, commits fall back to the winner's."""
    pick = lambda df, i, n: df.select("element_id", "miner_hotkey", "commit_block", F.lit(i).alias("p"), F.lit(n).alias("origin"))
    rows = pick(official, 0, "official").unionByName(pick(watchlist, 1, "watchlist")).unionByName(pick(winners, 2, "winner"))
    w = Window.partitionBy("element_id", "miner_hotkey").orderBy("p", F.desc("commit_block"))
    first = rows.withColumn("r", F.row_number().over(w)).where("r = 1").join(public.select("element_id").distinct(), "element_id", "left_semi")
    back = winners.select("element_id", "miner_hotkey", F.col("commit_block").alias("wc"))
    return first.join(back, ["element_id", "miner_hotkey"], "left").select("element_id", "miner_hotkey", F.coalesce("commit_block", "wc").alias("commit_block"), "origin")


def resolve_target_commit(targets: DataFrame, current: DataFrame) -> DataFrame:
    """targets with current_commit and status, against the newest commitments (element_id, hotkey, block)."""
    now = current.select("element_id", F.col("hotkey").alias("miner_hotkey"), F.col("block").alias("current_commit"))
    both = targets.join(now, ["element_id", "miner_hotkey"], "left")
    return both.withColumn("status", F.when(F.col("commit_block").isNull(), "winner_commit_block_missing").when(F.col("current_commit").isNull(), "current_commitment_missing").when(F.col("current_commit") != F.col("commit_block"), "new_commit_block").otherwise("ok"))


def spotcheck_eligibility(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (hotkey, model, revision) with reason: null if the registry holds the same model and revision."""
    r = registry.select("hotkey", F.col("model").alias("rm"), F.col("revision").alias("rr"))
    both = rows.join(r, "hotkey", "left")
    return both.withColumn("reason", F.when(F.col("rm").isNull(), "not_in_registry").when(F.col("rm") != F.col("model"), "model_changed").when(F.col("rr") != F.col("revision"), "revision_changed")).drop("rm", "rr")


def pending_checks(pending: DataFrame, live: DataFrame, version: str, n: int) -> DataFrame:
    """The n oldest pending checks of live miners under the same scoring version."""
    return pending.where(F.col("scoring_version") == version).join(live.select("hotkey").distinct(), "hotkey", "left_semi").orderBy("created", "check_id").limit(n)


def winner_target(snapshots: DataFrame) -> DataFrame:
    """(element_id, winner_hotkey, commit_block): the largest commit among the winner's own rows of both lists."""
    rows = F.array_union(F.coalesce("official", F.array().cast("array<struct<hotkey:string,commit_block:bigint>>")), F.coalesce("ranks", F.array().cast("array<struct<hotkey:string,commit_block:bigint>>")))
    own = F.filter(rows, lambda r: r["hotkey"] == F.col("winner_hotkey"))
    return snapshots.select("element_id", "winner_hotkey", F.array_max(F.transform(own, lambda r: r["commit_block"])).alias("commit_block"))


def audit_pairing(responses: DataFrame, truth: DataFrame, key: str = "challenge_id") -> DataFrame:
    """(key, n_response, n_truth, complete, exportable): one incomplete pair blocks the whole export."""
    a = responses.groupBy(key).agg(F.count("*").alias("n_response"))
    b = truth.groupBy(key).agg(F.count("*").alias("n_truth"))
    both = a.join(b, key, "full").na.fill(0, ["n_response", "n_truth"]).withColumn("complete", (F.col("n_response") > 0) & (F.col("n_truth") > 0))
    every = both.agg(F.coalesce(F.bool_and("complete"), F.lit(True)).alias("exportable"))
    return both.crossJoin(F.broadcast(every))  # one row


def weighted_fields(fields: Column, weights: dict[str, float]) -> Column:
    """The entries of a map that have a positive weight; null where none is left."""
    named = [n for n, w in sorted(weights.items()) if w > 0]
    kept = F.map_filter(fields, lambda k, v: k.isin(named) & v.isNotNull()) if named else F.map_filter(fields, lambda k, v: F.lit(False))
    return F.when(F.size(kept) > 0, kept)


def frame_actions(listed: Column) -> Column:
    """Frame and action of each entry of a JSON list that has both; null where none has."""
    rows = F.filter(F.from_json(listed, "array<struct<frame:bigint,action:string>>"), lambda r: r["frame"].isNotNull() & r["action"].isNotNull())
    return F.when(F.size(rows) > 0, rows)


def latency_streak(checks: DataFrame, keys: tuple[str, ...], passed: Column, order: tuple[str, ...], limit: int = 3) -> DataFrame:
    """Each check with streak (fails since the last pass) and status: PASS, PENDING_LATENCY or FAIL_LATENCY."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = checks.withColumn("_ok", passed.cast("int")).withColumn("_i", F.sum("_ok").over(w))
    run = Window.partitionBy(*keys, "_i").orderBy(*order)
    out = island.withColumn("streak", F.when(F.col("_ok") == 1, 0).otherwise(F.sum(1 - F.col("_ok")).over(run)).cast("bigint"))
    return out.withColumn("status", F.when(F.col("streak") == 0, "PASS").when(F.col("streak") >= limit, "FAIL_LATENCY").otherwise("PENDING_LATENCY")).drop("_ok", "_i")


def merge_failed_tuples(known: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (hotkey, element_id, commit_block): first_seen stays, last_seen and status move, latency bans that pass now go."""
    k = ["hotkey", "element_id", "commit_block"]
    n = new.select(*k, F.col("seen").alias("ns"), F.col("status").alias("nt"))
    both = known.join(n, k, "full")
    out = both.select(*k, F.coalesce("first_seen", "ns").alias("first_seen"), F.coalesce("ns", "last_seen").alias("last_seen"), F.when(F.col("nt").isNotNull(), F.col("nt")).otherwise(F.col("status")).alias("new_status"), "status")
    gone = (F.col("new_status") == "PASS") & (F.col("status").isNull() | (F.col("status") == "FAIL_LATENCY"))
    return out.where(~gone).select(*k, "first_seen", "last_seen", F.when(F.col("new_status") == "PASS", F.col("status")).otherwise(F.col("new_status")).alias("status"))


def target_status(checks: DataFrame, keys: tuple[str, ...] = ("hotkey", "element_id", "commit_block"), accept: int = 5, drifts: int = 2) -> DataFrame:
    """(keys, status, n_used) of check rows (ord, outcome): outcome is ok, drift, output, runtime or latency.

    Drifts beyond `drifts` count as output failures; rows after the accept-th accepted one are ignored.
    """
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    run = checks.withColumn("d", F.sum(F.when(F.col("outcome") == "drift", 1).otherwise(0)).over(w))
    real = F.when((F.col("outcome") == "drift") & (F.col("d") > drifts), "output").otherwise(F.col("outcome"))
    run = run.withColumn("real", real).withColumn("a", F.sum(F.when(F.col("real").isin("ok", "drift", "latency"), 1).otherwise(0)).over(w))
    used = run.where((F.col("a") < accept) | ((F.col("a") == accept) & F.col("real").isin("ok", "drift", "latency")))
    n = lambda v: F.count_if(F.col("real") == v)
    return used.groupBy(*keys).agg(F.when(n("output") > 0, "FAIL_OUTPUT").when(n("runtime") > 0, "FAIL_RUNTIME").when(n("latency") >= 3, "FAIL_LATENCY").when(n("latency") > 0, "PENDING_LATENCY").when(n("ok") + n("drift") > 0, "PASS").otherwise("SKIP").alias("status"), F.count("*").alias("n_used"))


def compact_index(keys: DataFrame, archive: DataFrame, days: int) -> DataFrame:
    """(key, place): keys older than the newest block less `days` move from index to archive, unknown blocks stay; sorted sets."""
    top = keys.agg((F.max("block") - days * 7200).alias("cut"))
    split = keys.crossJoin(F.broadcast(top)).select("key", F.when(F.col("block") < F.col("cut"), "archive").otherwise("index").alias("place"))
    return split.union(archive.select("key", F.lit("archive"))).distinct().orderBy("place", "key")


def index_add(index: DataFrame, new: DataFrame) -> DataFrame:
    return index.select("key").union(new.select("key")).distinct().orderBy("key")


def rescored(published: DataFrame, again: DataFrame, key: str, threshold: float = 0.95) -> DataFrame:
    """(key, central_score, audit_score, match, passed): published scores against recomputed ones; a missing one is 0."""
    from ..functions.exprs import match_percentage

    both = published.select(key, F.col("score").alias("central_score")).join(again.select(key, F.col("score").alias("audit_score")), key, "left").na.fill(0.0, ["audit_score"])
    return both.withColumn("match", match_percentage(F.col("central_score"), F.col("audit_score"))).withColumn("passed", F.col("match") >= threshold)


def audit_export(rows: DataFrame, weights: dict[str, float], key: str = "challenge_id") -> DataFrame:
    """(key, truth_type, response, truth, complete, exportable): both sides of each pair reduced to what an audit compares, as JSON.

    rows are (key, truth_type, response, truth), the sides as JSON text. `cricket` keeps the fields with a positive weight and a
    value, in name order; `actions` keeps frame and action of each entry that has both. A side of which nothing is left, or
    that is no JSON, is null and makes its pair incomplete, as does another type. One incomplete pair blocks the
    whole export: exportable is one flag for all rows.
    """

    def reduced(side: str) -> Column:
        fields = weighted_fields(F.from_json(side, "map<string,string>"), weights)
        ordered = F.map_from_entries(F.array_sort(F.map_entries(fields)))
        return F.when(F.col("truth_type") == "cricket", F.to_json(ordered)).when(F.col("truth_type") == "actions", F.to_json(frame_actions(F.col(side))))

    pairs = rows.select(key, "truth_type", reduced("response").alias("response"), reduced("truth").alias("truth"))
    pairs = pairs.withColumn("complete", F.col("response").isNotNull() & F.col("truth").isNotNull())
    every = pairs.agg(F.coalesce(F.bool_and("complete"), F.lit(True)).alias("exportable"))
    return pairs.crossJoin(F.broadcast(every))  # one row
