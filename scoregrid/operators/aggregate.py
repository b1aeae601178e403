"""Aggregations: means by miner, modes, medians, percentiles by index, recent batches, diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_commit(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The most frequent commit of each key, ties to the larger."""
    n = df.groupBy(*keys, "commit_block").agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by("commit_block", F.struct("_n", "commit_block")).alias("commit_block"))


def mean_by_miner(df: DataFrame, keys: tuple[str, ...] = ("element_id", "uid", "miner_hotkey")) -> DataFrame:
    """Sum, count and mean of scores by miner, with first_seen: the order of the miner's first row."""
    return df.groupBy(*keys).agg(F.sum("score").alias("total"), F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.min(F.struct("block", "seq")).alias("first_seen"))


def private_aggregate(df: DataFrame) -> DataFrame:
    """(hotkey, total, n) without time-outs, null and non-finite scores."""
    good = df.where(~F.coalesce(F.col("timed_out"), F.lit(False)) & F.col("score").isNotNull() & ~F.isnan("score") & F.col("miner_hotkey").isNotNull())
    return good.groupBy("miner_hotkey").agg(F.sum("score").alias("total"), F.count("*").alias("n"))


def with_fallback(means: DataFrame, uid: int) -> DataFrame:
    """means, or one row of the fallback uid with score 0 where there are none."""
    empty = means.agg(F.count("*").alias("_c")).where("_c = 0").select(F.lit(uid).cast("int").alias("uid"), F.lit(0.0).alias("avg_score"))
    return means.select("uid", "avg_score").union(empty)


def reject_diagnostics(df: DataFrame) -> DataFrame:
    """Rows by reason, with distinct sources."""
    return df.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("validator_hotkey").alias("n_sources"))


BUCKETS = 256


def _bucket(value: Column, bounds: Column) -> Column:
    """How many of the ascending bounds (an array column) are <= value, by halving."""
    down = F.array(*[F.lit(BUCKETS >> k) for k in range(1, BUCKETS.bit_length())])
    return F.aggregate(down, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def values_at(df: DataFrame, keys: tuple[str, ...], value: str, *ranks: Callable[[Column], Column], weight: Column | None = None) -> DataFrame:
    """(keys, total, r0, r1, ...): for each rank the smallest value up to which a key's weights sum to it, exactly.

    Each of `ranks` is given the key's total weight; left out, the weight of a row is 1 and ranks are places from 1. Rows of
    null values or of no positive weight are left out.

    No key's rows are sorted or sent together: approximate quantiles cut a key's values into BUCKETS ranges, the weights of
    ranges (partial sums first) say which one holds a rank, and only that range's values, each with its weight once,
    are looked at in order.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("decimal(38,12)")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), w.alias("_w")).where("_w > 0")
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / BUCKETS for i in range(1, BUCKETS)], 2000).alias("_cuts"))
    valued = rows.join(cuts, list(keys)).withColumn("_b", _bucket(F.col("_v"), F.col("_cuts"))).groupBy(*keys, "_b", "_v").agg(F.sum("_w").alias("_w"))
    ranges = valued.groupBy(*keys, "_b").agg(F.sum("_w").alias("_s"))
    of_key = Window.partitionBy(*keys)
    placed = ranges.withColumns({"_before": F.sum("_s").over(of_key.orderBy("_b")) - F.col("_s"), "_total": F.sum("_s").over(of_key)})  # at most BUCKETS rows a key
    holds = [(F.col("_before") < r(F.col("_total"))) & (r(F.col("_total")) <= F.col("_before") + F.col("_s")) for r in ranks]
    any_rank = holds[0]
    for h in holds[1:]:
        any_rank = any_rank | h
    inside = valued.join(placed.where(any_rank).select(*keys, "_b", "_before", "_total"), [*keys, "_b"])
    order = Window.partitionBy(*keys, "_b").orderBy("_v")
    run = inside.withColumn("_upto", F.sum("_w").over(order) + F.col("_before"))
    return run.groupBy(*keys).agg(F.first("_total").alias("total"), *[F.min(F.when(F.col("_upto") >= r(F.col("_total")), F.col("_v"))).alias(f"r{i}") for i, r in enumerate(ranks)])


def median(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, median): the middle value, or halfway between the two middle ones."""
    two = values_at(df, keys, value, lambda n: F.floor((n + 1) / 2), lambda n: F.floor(n / 2) + 1)
    return two.select(*keys, (F.col("r0") + (F.col("r1") - F.col("r0")) * 0.5).alias("median"))


def weighted_median(df: DataFrame, keys: tuple[str, ...], value: str, weight: str) -> DataFrame:
    """The smallest value whose cumulative positive weight reaches half; without weight the plain median."""
    heavy = values_at(df, keys, value, lambda t: t / 2, weight=F.col(weight)).select(*keys, F.col("r0").alias("_r"))
    has = df.groupBy(*keys).agg(F.max(F.coalesce(F.col(weight) > 0, F.lit(False)) & F.col(value).isNotNull()).alias("_has"))
    plain = median(df.join(has.where(~F.col("_has")), list(keys), "left_semi"), keys, value)
    return has.join(heavy, list(keys), "left").join(plain, list(keys), "left").select(*keys, F.coalesce("_r", "median").alias("median"))


def p95_index(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """sorted[int(0.95 * (n - 1))], by position: neither a continuous nor a discrete percentile."""
    return values_at(df, keys, value, lambda n: F.floor(0.95 * (n - 1)) + 1).select(*keys, F.col("r0").alias("p95"))


def challenge_map(df: DataFrame, keys: tuple[str, ...] = ("element_id", "miner_hotkey"), recent: int | None = None, eligible: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Last score of each (key, challenge); recent: of the last so many rows only, taken before repeats overwrite.

    eligible, excluded: tables of challenge_id; only the former's and none of the latter's rows count.
    """
    if eligible is not None:
        df = df.join(eligible.select("challenge_id").distinct(), "challenge_id", "left_semi")
    if excluded is not None:
        df = df.join(excluded.select("challenge_id").distinct(), "challenge_id", "left_anti")
    if recent is not None:
        w = Window.partitionBy(*keys).orderBy(F.desc("block"), F.desc("seq"))
        df = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent).drop("_r")
    return df.groupBy(*keys, "challenge_id").agg(F.max_by("score", F.struct("block", "seq")).alias("score"))


def inactive_miners(means: DataFrame, least: int = 30) -> DataFrame:
    """Miners of more than `least` samples, a mean of 0 and a known commit."""
    return means.where((F.col("n") > least) & (F.abs("avg_score") <= 1e-12) & F.col("commit_block").isNotNull())


def mad_prune(df: DataFrame, keys: tuple[str, ...], value: str = "score", weight: str = "stake", k: float = 3.0) -> DataFrame:
    """Weighted mean of the values within k median absolute deviations of the median."""
    med = median(df, keys, value).withColumnRenamed("median", "_m")
    dev = df.join(med, list(keys)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = median(dev, keys, "_d").withColumnRenamed("median", "_mad")
    kept = dev.join(mad, list(keys)).where(F.col("_d") <= k * F.col("_mad"))
    return kept.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.count("*").alias("n_kept"))


def element_window_summary(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """(window_id, element_id, n_clips, n_miners, theta, beta): needs window_id."""
    n = df.groupBy("window_id", "element_id").agg(F.count_distinct("challenge_id").alias("n_clips"), F.count_distinct("miner_hotkey").alias("n_miners"))
    return n.join(F.broadcast(manifest.select("element_id", "theta", "beta")), "element_id").select("window_id", "element_id", "n_clips", "n_miners", "theta", "beta")


def clip_means(df: DataFrame, tempo: int, values: tuple[str, ...], keys: tuple[str, ...] = ("element_id", "miner_hotkey"), unit: float = 1e-9) -> DataFrame:
    """(start, keys, n, a mean for each value) of each window of tempo blocks.

    Values are summed as whole numbers of `unit`, so that a mean does not depend on the order of its rows; means are rounded
    half up to a thousand units. Null values count as rows and add nothing.
    """
    whole = lambda v: F.floor(F.col(v) / unit + 0.5).cast("decimal(28,0)")
    sums = df.groupBy((F.floor(F.col("block") / tempo) * tempo).alias("start"), *keys).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(whole(v)), F.lit(0)).cast("decimal(38,0)").alias(v) for v in values])
    mean = lambda v: F.expr(f"(2 * {v} + 1000 * n) div (2000 * n)") * (unit * 1000)
    return sums.select("start", *keys, "n", *[mean(v).alias(v) for v in values])
