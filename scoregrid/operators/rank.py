"""Ranking, tie-break, weight allocation and the economics of shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import challenge_map
from .select import UNKNOWN_COMMIT

SHARES = (0.80, 0.15, 0.05)  # fixed values: ranked parts of an element's weight


def top_rows(means: DataFrame, k: int, least: int = 1, most: int | None = None) -> DataFrame:
    """The k best of each element by mean, samples and uid; zero means never rank."""
    ok = means.where((F.col("n") >= least) & (F.col("avg_score") > 1e-12))
    if most is not None:
        ok = ok.where(F.col("n") <= most)
    w = Window.partitionBy("element_id").orderBy(F.desc("avg_score"), F.desc("n"), "uid")
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def provisional_winner(means: DataFrame, own_uid: int | None = None) -> DataFrame:
    """Best mean of each element; ties go to the miner that was seen first."""
    if own_uid is not None:
        means = means.where(F.col("uid") != own_uid)
    w = Window.partitionBy("element_id").orderBy(F.desc("avg_score"), "first_seen")
    return means.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def similar(left: DataFrame, right: DataFrame, delta: Column | float, least_common: int = 5, least_abs: float = 0.05, rejecting: int = 2) -> DataFrame:
    """(element_id, candidate, similar, compared, failed, max_diff): left is one miner's challenge map, right the candidates'.

    Only challenges where both scores are non-zero count; one failure is tolerated, `rejecting` are not.
    """
    both = left.select("element_id", "challenge_id", F.col("score").alias("a")).join(right.select("element_id", F.col("miner_hotkey").alias("candidate"), "challenge_id", F.col("score").alias("b")), ["element_id", "challenge_id"])
    both = both.where((F.abs("a") > 1e-9) & (F.abs("b") > 1e-9)).withColumn("d", F.abs(F.col("a") - F.col("b")))
    rel = delta if isinstance(delta, Column) else F.lit(delta)
    bad = F.col("d") > F.greatest(F.lit(least_abs), rel * F.greatest(F.abs("a"), F.abs("b")))
    out = both.groupBy("element_id", "candidate").agg(F.count("*").alias("compared"), F.count_if(bad).alias("failed"), F.max("d").alias("max_diff"))
    return out.withColumn("similar", (F.col("compared") >= least_common) & (F.col("failed") < rejecting))


def tiebreak(rows: DataFrame, winners: DataFrame, commits: DataFrame, recent: int = 10, delta: float = 0.1, least_common: int = 8) -> DataFrame:
    """winners with final_hotkey: of the provisional winner and the miners that are similar to it on the recent batch and
    on all history, the one with the earliest commit, then the smaller hotkey. Unknown commits come last.

    One side of both joins is the winner's own map, so no pairs of candidates are formed.
    """
    flags = []
    for k in (recent, None):
        maps = challenge_map(rows, recent=k)
        mine = maps.join(winners.select("element_id", F.col("miner_hotkey")), ["element_id", "miner_hotkey"], "left_semi")
        flags.append(similar(mine, maps, delta, least_common).where("similar").select("element_id", "candidate"))
    alike = flags[0].join(flags[1], ["element_id", "candidate"], "left_semi").union(winners.select("element_id", F.col("miner_hotkey").alias("candidate"))).distinct()
    ages = commits.select("element_id", F.col("miner_hotkey").alias("candidate"), "commit_block")
    best = alike.join(ages, ["element_id", "candidate"], "left").groupBy("element_id").agg(F.min(F.struct(F.coalesce("commit_block", F.lit(UNKNOWN_COMMIT)).alias("c"), F.col("candidate").alias("h"))).alias("m"), F.count("*").alias("n_alike"))
    return winners.join(best, "element_id").select(*winners.columns, F.col("m.h").alias("final_hotkey"), "n_alike")


def final_routing(winner: Column, score: Column, eligible: Column, fallback: int) -> Column:
    """The winner's uid, or the fallback where it is not eligible or scored nothing."""
    return F.when(eligible & (score > 0), winner).otherwise(F.lit(fallback))


def ranked_shares(top: DataFrame, weight: str = "weight") -> DataFrame:
    """Parts of an element's weight for ranks 1 to 3; unfilled ranks are not redistributed."""
    share = F.when(F.col("rank") == 1, SHARES[0]).when(F.col("rank") == 2, SHARES[1]).when(F.col("rank") == 3, SHARES[2])
    return top.where("rank <= 3").withColumn("share", share * F.col(weight))


def allocate_weights(parts: DataFrame, fallback: int, blacklisted: list[int] | None = None) -> DataFrame:
    """(uid, weight) that sum to 1: over 1 is scaled down, what is missing goes to the fallback uid."""
    if blacklisted:
        parts = parts.where(~F.col("uid").isin(blacklisted))
    sums = parts.where(F.col("share") > 0).groupBy("uid").agg(F.sum("share").alias("w"))
    total = sums.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("t"))  # one row
    scaled = sums.crossJoin(F.broadcast(total)).select("uid", (F.col("w") / F.greatest(F.col("t"), F.lit(1.0))).alias("w"))
    rest = total.select(F.lit(fallback).cast("int").alias("uid"), F.greatest(1 - F.col("t"), F.lit(0.0)).alias("w")).where("w > 0")
    return scaled.select(F.col("uid").cast("int").alias("uid"), "w").union(rest).groupBy("uid").agg(F.sum("w").alias("weight"))


def snapshot(top: DataFrame, watch: DataFrame, winners: DataFrame) -> DataFrame:
    """One row an element: winner, ranked official rows and watchlist as arrays."""
    pack = lambda df, n: df.groupBy("element_id").agg(F.array_sort(F.collect_list(F.struct("rank", "uid", "miner_hotkey", "avg_score", "n"))).alias(n))
    return winners.select("element_id", F.col("uid").alias("winner_uid"), F.col("miner_hotkey").alias("winner_hotkey")).join(pack(top, "official"), "element_id", "left").join(pack(watch, "watchlist"), "element_id", "left")


def ewma(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, half_life: float) -> DataFrame:
    """Last exponentially weighted mean of each key: alpha = 1 - 2^(-1/h), the first value seeds.

    Written in closed form, a weighted sum by the number of later rows, so that no key's rows are gathered in an array.
    """
    keep = 2.0 ** (-1.0 / half_life)
    w = Window.partitionBy(*keys)
    at = df.withColumns({"_k": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    part = F.pow(F.lit(keep), F.col("_n") - F.col("_k")) * F.when(F.col("_k") == 1, 1.0).otherwise(1 - keep)
    return at.groupBy(*keys).agg(F.sum(F.col(value) * part).alias("ewma"), F.max("_n").alias("n"))


def miner_share(df: DataFrame, weight: str = "weight", perf: str = "avg_score") -> DataFrame:
    total = F.sum(perf).over(Window.partitionBy("element_id"))
    return df.withColumn("share", F.when(total > 0, F.col(weight) * F.col(perf) / total).otherwise(0.0))


def concentration_guard(share: Column, limit: float, damping: float) -> Column:
    """Above the limit only 1 - damping of the excess counts."""
    return F.when(share > limit, limit + (share - limit) * (1 - damping)).otherwise(share)


def emission_split(weight: Column, quality: Column, gamma: float) -> tuple[Column, Column]:
    """(part for miners, part burnt); an element without quality burns all."""
    pay = F.when(quality > 0, weight * gamma).otherwise(0.0)
    return pay, weight - pay


def trusted_composite(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Weights .35, .35, .20 and .10."""
    return 0.35 * a + 0.35 * b + 0.20 * c + 0.10 * d


def discovery_multiplier(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(1.0)), F.lit(1.03))


def fill_ratio(available: Column, requests: Column) -> Column:
    return F.when(requests > 0, F.least(F.lit(1.0), available / requests)).otherwise(0.0)
