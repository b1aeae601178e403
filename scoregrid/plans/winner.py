"""Winner of each element over a look-back: the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import mean_by_miner, mode_commit
from ..operators.rank import allocate_weights, final_routing, provisional_winner, ranked_shares, tiebreak, top_rows
from ..operators.select import exclude_blacklist, latest_commit_filter, tail_filter, warmup_trim


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, for a plan that reads it several times; as it is where no folder is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def eligible_rows(shards: DataFrame, tail: int = 216_000, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the newest commits inside the look-back, without blacklisted miners and warm-up zeros."""
    return warmup_trim(exclude_blacklist(tail_filter(latest_commit_filter(shards), tail), list(blacklist)))


def winners(shards: DataFrame, tail: int = 216_000, least: int = 5, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """(element_id, uid, miner_hotkey, avg_score, n, commit_block) of each element's best miner; all elements in one job."""
    rows = eligible_rows(shards, tail, blacklist)
    means = mean_by_miner(rows).where(F.col("n") >= least)
    best = provisional_winner(means)
    commit = mode_commit(rows, ("element_id", "miner_hotkey"))
    return best.join(commit, ["element_id", "miner_hotkey"], "left").select("element_id", "uid", "miner_hotkey", "avg_score", "n", "commit_block")


def window_weights(shards: DataFrame, manifest: DataFrame, fallback: int = 0, tail: int = 216_000, least: int = 5) -> DataFrame:
    """(uid, weight): public elements pay their tie-broken winner in full, private ones their first three ranks."""
    rows = kept(eligible_rows(shards, tail).select("element_id", "uid", "miner_hotkey", "validator_hotkey", "challenge_id", "block", "seq", "score", "commit_block", "lane"))
    means = kept(mean_by_miner(rows).where(F.col("n") >= least))
    commits = mode_commit(rows, ("element_id", "miner_hotkey"))
    final = tiebreak(rows, provisional_winner(means), commits, least_common=3)
    whole = F.broadcast(manifest.select("element_id", "weight", "track"))  # a row for each element of one manifest
    uids = means.select("element_id", F.col("miner_hotkey").alias("final_hotkey"), F.col("uid").alias("final_uid"), F.col("avg_score").alias("final_score"))
    public = final.join(uids, ["element_id", "final_hotkey"], "left").join(whole, "element_id").where("track = 'public'")
    public = public.select(final_routing(F.col("final_uid"), F.col("final_score"), F.col("final_uid").isNotNull(), fallback).cast("int").alias("uid"), F.col("weight").alias("share"))
    private = ranked_shares(top_rows(means, 3).join(whole, "element_id").where("track = 'private'")).select(F.col("uid").cast("int").alias("uid"), "share")
    return allocate_weights(public.union(private), fallback)
