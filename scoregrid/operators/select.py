"""Filters over sets, latest-per-key, de-duplication, as-of choice, trims and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import BLOCKS_PER_DAY, element_in_key, live_places, set_key

UNKNOWN_COMMIT = 10**18


def tail_filter(df: DataFrame, tail: int, block: str = "block") -> DataFrame:
    """Rows of the last `tail` blocks, with max_block and min_block; the floor is included.

    The maximum is one row, joined back as a broadcast, so the rows themselves are not shuffled.
    """
    top = df.agg(F.max(block).alias("max_block")).withColumn("min_block", F.col("max_block") - tail)
    return df.crossJoin(F.broadcast(top)).where(F.col(block) >= F.col("min_block"))


def latest_commit_filter(df: DataFrame, keys: tuple[str, ...] = ("element_id", "miner_hotkey"), commit: str = "commit_block") -> DataFrame:
    """Rows of the newest commit of each key; rows whose key or commit can't be read (null) pass."""
    newest = df.where(F.col(commit).isNotNull()).groupBy(*keys).agg(F.max(commit).alias("_newest"))
    both = df.join(newest, list(keys), "left")
    return both.where(F.col("_newest").isNull() | F.col(commit).isNull() | (F.col(commit) == F.col("_newest"))).select(*df.columns)


def exclude(df: DataFrame, listed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows without an equal row in `listed` on keys (failed tuples, inactive tuples, blacklists)."""
    return df.join(listed.select(*keys).distinct(), list(keys), "left_anti")


def failed_tuples(rows: DataFrame) -> DataFrame:
    """(hotkey, element_id, commit_block) of failure rows that name their latest run."""
    return rows.where(F.col("latest_run_key").isNotNull() & (F.trim("latest_run_key") != "")).select("hotkey", "element_id", "commit_block").distinct()


def exclude_blacklist(df: DataFrame, fixed: list[str], listed: DataFrame | None = None, bypass: Column | None = None, hotkey: str = "miner_hotkey") -> DataFrame:
    """Rows whose hotkey is in neither list, and rows that the bypass lets through."""
    hit = F.col(hotkey).isin(fixed) if fixed else F.lit(False)
    out = df.withColumn("_hit", hit)
    if listed is not None:
        out = out.join(listed.select(F.col("hotkey").alias("_bad")).distinct(), F.col(hotkey) == F.col("_bad"), "left").withColumn("_hit", F.col("_hit") | F.col("_bad").isNotNull())
    keep = ~F.col("_hit") if bypass is None else ~F.col("_hit") | bypass
    return out.where(keep).select(*df.columns)


def latest_commit_for_element(commits: DataFrame, role: str = "miner") -> DataFrame:
    """The newest commit of each (element, hotkey) with its payload columns."""
    rest = [c for c in commits.columns if c not in ("hotkey", "element_id", "block", "role")]
    newest = commits.where(F.col("role") == role).groupBy("element_id", "hotkey").agg(F.max(F.struct("block", *rest)).alias("r"))
    return newest.select("element_id", "hotkey", "r.*")


def latest_private_commit(commits: DataFrame) -> DataFrame:
    """The newest private commit of each (element, hotkey): its track is private, and its role is miner or left out. Needs the column track."""
    own = (F.col("track") == "private") & (F.col("role").isNull() | (F.col("role") == "miner"))
    return latest_commit_for_element(commits.where(own).withColumn("role", F.lit("miner")))


def common_history(winner: DataFrame, candidate: DataFrame, excluded: DataFrame, window: str, n: int, keys: tuple[str, ...] = ("element_id",)) -> DataFrame:
    """(keys, challenge_id, winner_score, candidate_score): of the challenges that both histories of a key hold and `excluded` does not name, the first n (one at least) by sha256(window:id).

    Every validator takes the same ones. Histories are (keys, challenge_id, score), excluded is (challenge_id).
    """
    one, two = winner.withColumnRenamed("score", "winner_score"), candidate.withColumnRenamed("score", "candidate_score")
    both = one.join(two, [*keys, "challenge_id"]).join(excluded.select("challenge_id").distinct(), "challenge_id", "left_anti")
    order = Window.partitionBy(*keys).orderBy(F.sha2(F.concat(F.lit(window + ":"), F.col("challenge_id")), 256), "challenge_id")
    return both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(1, n)).select(*keys, "challenge_id", "winner_score", "candidate_score")


def latest_validator_index(commits: DataFrame, hotkey: str | None = None, role: str = "central_validator", url: str = "url") -> DataFrame:
    """The newest commit of each validator hotkey (or of one) whose address is http or https: (hotkey, block, url)."""
    rows = commits.where((F.col("role") == role) & F.lower(F.trim(url)).rlike("^https?://"))
    rows = rows if hotkey is None else rows.where(F.col("hotkey") == hotkey)
    return rows.groupBy("hotkey").agg(F.max(F.struct("block", F.trim(url).alias(url))).alias("r")).select("hotkey", "r.block", f"r.{url}")


def element_keys(keys: DataFrame, root: str, element: str, key: str = "key") -> DataFrame:
    """Keys and addresses below one element's folder."""
    return keys.where(element_in_key(key, root, F.lit(element)))


def prior_scored(miners: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("element_id", "miner_hotkey")) -> DataFrame:
    """Miners that an index already names for the element."""
    return miners.join(index.select(*keys).distinct(), list(keys), "left_semi")


def with_uids(scores: DataFrame, registry: DataFrame, hotkey: str = "miner_hotkey") -> DataFrame:
    """scores with the uid that the registry (hotkey, uid) gives a hotkey now; departed hotkeys go. Of several uids of a hotkey the smallest counts."""
    now = registry.where(F.col("hotkey").isNotNull()).groupBy(F.col("hotkey").alias(hotkey)).agg(F.min("uid").alias("uid"))
    return scores.drop("uid").join(now, hotkey)


def extract_scores(payloads: DataFrame, registry: DataFrame) -> DataFrame:
    """(uid, miner_hotkey, score) of payload rows (hotkey, metric_score, payload_score) whose trimmed hotkey the registry knows: the metric's composite, else the payload's, else 0."""
    named = payloads.withColumn("miner_hotkey", F.nullif(F.trim("hotkey"), F.lit("")))
    return with_uids(named, registry).select("uid", "miner_hotkey", F.coalesce("metric_score", "payload_score", F.lit(0.0)).alias("score"))


def commit_block_by_miner(live: DataFrame, archive: DataFrame, first_block: int) -> DataFrame:
    """Newest commit block of each (element, hotkey) in the live list, else in the archive from first_block on."""
    now = live.where("role = 'miner'").groupBy("element_id", "hotkey").agg(F.max("block").alias("a"))
    old = archive.where(f"role = 'miner' and block >= {first_block}").groupBy("element_id", "hotkey").agg(F.max("block").alias("b"))
    return now.join(old, ["element_id", "hotkey"], "full").select("element_id", "hotkey", F.coalesce("a", "b").alias("commit_block"))


def dedup_by_model_revision(rows: DataFrame, order: tuple[str, ...] = ("block", "hotkey")) -> DataFrame:
    """rows with kept and keeper: the earliest commit of each (model, revision) stays, the others name its hotkey."""
    w = Window.partitionBy("model", "revision").orderBy(*order)
    return rows.withColumns({"kept": F.row_number().over(w) == 1, "keeper": F.first("hotkey").over(w)})


def registry_select(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows with skip_reason: the first rule whose condition holds; null for the kept ones."""
    return rows.withColumn("skip_reason", F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules], F.lit(None).cast("string")))


def repo_facts(files: DataFrame) -> DataFrame:
    """(model, revision, total_mb, n_onnx, only_onnx) of a file listing (model, revision, path, size)."""
    onnx = F.lower("path").endswith(".onnx")
    weights = F.lower("path").rlike(r"\.(onnx|pt|pth|bin|safetensors|pkl|h5|engine)$")
    return files.groupBy("model", "revision").agg((F.sum("size") / 1048576.0).alias("total_mb"), F.count_if(onnx).alias("n_onnx"), ((F.count_if(onnx) > 0) & (F.count_if(weights & ~onnx) == 0)).alias("only_onnx"))


def artifact_problems(files: DataFrame, allowed: list[str], forbidden: list[str], most_bytes: int) -> DataFrame:
    """(model, revision, total_bytes, n_onnx, problem) of a file listing (model, revision, path, size); problem is null for a good one.

    Compiled caches do not count. By path, the first file with a forbidden suffix or one that is not allowed is the
    problem; then a size over most_bytes; then no model file at all.
    """
    suffix = F.lower(F.regexp_extract("path", r"[^/.][^/]*?(\.[^./]+)$", 1))
    live = files.where(~F.col("path").contains("__pycache__") & (suffix != ".pyc"))
    name = F.element_at(F.split("path", "/"), -1)
    bad = F.when(suffix.isin(forbidden), F.concat(F.lit("disallowed_binary_artifact:"), name)).when((suffix != "") & ~suffix.isin(allowed), F.concat(F.lit("unsupported_artifact_suffix:"), name))
    total = live.groupBy("model", "revision").agg(F.sum("size").alias("total_bytes"), F.count_if(suffix == ".onnx").alias("n_onnx"), F.min(F.when(bad.isNotNull(), F.struct("path", bad.alias("bad")))).alias("b"))
    out = files.select("model", "revision").distinct().join(total, ["model", "revision"], "left").na.fill(0, ["total_bytes", "n_onnx"])
    size = F.when(F.col("total_bytes") > most_bytes, F.concat(F.lit("repo_size_exceeded:"), F.col("total_bytes").cast("string"), F.lit(f">{most_bytes}")))
    return out.select("model", "revision", "total_bytes", "n_onnx", F.coalesce(F.col("b.bad"), size, F.when(F.col("n_onnx") == 0, "no_onnx_model_found")).alias("problem"))


def as_of(rows: DataFrame, versions: DataFrame, at: str = "block", version_at: str = "from_block", fallback: bool = True, span: int = 7 * BLOCKS_PER_DAY, expires: str | None = None) -> DataFrame:
    """rows with the version of the largest version_at <= at; without one the largest overall (fallback) or nulls.

    expires: a column of versions; a row at or after it is an error, as for a manifest that has run out. Of versions of
    equal blocks one row counts. Rows and versions are united and cut into ranges of `span` blocks; in a range the
    newest version so far is a running maximum, and what a range begins with is the largest version of those before it,
    from a table of one row a range.
    """
    newest = versions.groupBy(version_at).agg(F.max(F.struct(*[c for c in versions.columns if c != version_at])).alias("_v")) if len(versions.columns) > 1 else versions.distinct().withColumn("_v", F.lit(None).cast("string"))
    points = rows.select(F.col(at).alias("_at")).distinct().select("_at", F.lit(None).cast("bigint").alias("_from")).union(newest.select(F.col(version_at).alias("_at"), F.col(version_at).cast("bigint").alias("_from")))
    points = points.where("_at is not null").withColumn("_range", F.floor(F.col("_at") / span))
    ends = points.groupBy("_range").agg(F.max("_from").alias("_last")).withColumn("_carried", F.max("_last").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    running = F.max("_from").over(Window.partitionBy("_range").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = points.withColumn("_run", running).join(ends.select("_range", "_carried"), "_range").select("_at", F.coalesce("_run", "_carried").alias("_hit")).distinct()
    if fallback:
        found = found.crossJoin(F.broadcast(versions.agg(F.max(version_at).alias("_most")))).select("_at", F.coalesce("_hit", "_most").alias("_hit"))  # one row
    out = rows.join(found, F.col(at) == F.col("_at"), "left").join(newest, F.col("_hit") == F.col(version_at), "left")
    named = [F.col("_v")[c].alias(c) for c in versions.columns if c != version_at]
    out = out.select(*rows.columns, version_at, *named)
    if expires is not None:
        out = out.withColumn(expires, F.when(F.col(at) < F.col(expires), F.col(expires)).when(F.col(expires).isNull(), F.col(expires)).otherwise(F.raise_error(F.concat(F.lit("expired version at block "), F.col(at).cast("string"))).cast(dict(versions.dtypes)[expires])))
    return out


def warmup_trim(df: DataFrame, window_blocks: int = 3 * BLOCKS_PER_DAY, most: int = 5, keys: tuple[str, ...] = ("element_id", "miner_hotkey"), order: tuple[str, ...] = ("block", "seq")) -> DataFrame:
    """Drops up to `most` leading zero scores of recent commits, in block order; the private lane and unknown commits keep all.

    Needs max_block (tail_filter), lane, commit_block and score.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = F.max(F.when(F.abs("score") > 1e-12, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    recent = (F.col("lane") != "private") & F.col("commit_block").isNotNull() & (F.col("max_block") - F.col("commit_block") <= window_blocks)
    out = df.withColumns({"_seen": seen, "_n": F.row_number().over(w)})
    return out.where(~(F.coalesce(recent, F.lit(False)) & (F.col("_seen") == 0) & (F.col("_n") <= most))).drop("_seen", "_n")


def sample(df: DataFrame, seed: str, n: int, keys: tuple[str, ...] = (), name: str = "challenge_id") -> DataFrame:
    """The n rows of each key that come first by sha2(seed:name); reproducible."""
    w = Window.partitionBy(*keys).orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(name).cast("string")), 256), name)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def audit_candidates(df: DataFrame, keys: tuple[str, ...] = ("element_id", "miner_hotkey", "commit_block"), newest: int = 10) -> DataFrame:
    """Rows but the newest ten of each key; keys of ten rows or fewer give none."""
    w = Window.partitionBy(*keys).orderBy(F.desc("block"), F.desc("seq"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > newest).drop("_r")


def challenge_sample_per_target(df: DataFrame, seed: str, k: int, keys: tuple[str, ...] = ("element_id", "miner_hotkey", "commit_block")) -> DataFrame:
    """At most k positive rows with different response keys of each target; of equal response keys the first (block, seq) counts."""
    w = Window.partitionBy(*keys, "responses_key").orderBy("block", "seq")
    unique = df.where((F.col("score") > 0) & F.col("responses_key").isNotNull()).withColumn("_u", F.row_number().over(w)).where("_u = 1").drop("_u")
    return sample(unique, seed, k, keys, "responses_key")


def historical_sample(pairs: DataFrame, window: str, n: int) -> DataFrame:
    """First n challenge ids by sha256(window:id)."""
    return pairs.withColumn("rank_hash", F.sha2(F.concat(F.lit(window + ":"), F.col("challenge_id")), 256)).orderBy("rank_hash").limit(n)


def window_shard_dedup(df: DataFrame, keys: tuple[str, ...] = ("window_id", "miner_hotkey", "element_id", "challenge_id")) -> DataFrame:
    """One row a key: the smallest source, then the earliest ingest."""
    w = Window.partitionBy(*keys).orderBy("validator_hotkey", "seq")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# Places of four keypoints that do not fix a frame, as they lie on few lines.
WEAK_QUADS = [
    [23, 24, 27, 28], [7, 8, 3, 4], [2, 10, 1, 14], [18, 26, 14, 25], [5, 13, 6, 17], [21, 29, 17, 30], [10, 11, 2, 3], [10, 11, 2, 7], [12, 13, 4, 5],
    [12, 13, 5, 8], [18, 19, 26, 27], [18, 19, 26, 23], [20, 21, 24, 29], [20, 21, 28, 29], [8, 4, 5, 13], [3, 7, 2, 10], [23, 27, 18, 26], [24, 28, 21, 29],
]


def weak_quads(spark) -> DataFrame:
    return spark.createDataFrame([(q,) for q in WEAK_QUADS], "places array<int>")


def mark_weak_quads(frames: DataFrame, quads: DataFrame, points: str = "points") -> DataFrame:
    """frames with weak: exactly four points are live, and they are one of the quads (places, in any order). Quads meet frames by the key of their set."""
    key = set_key(live_places(F.col(points)))
    listed = quads.select(set_key(F.col("places")).alias("_quad")).distinct()
    four = frames.withColumn("_key", F.when(F.size(live_places(F.col(points))) == 4, key))
    return four.join(F.broadcast(listed), F.col("_key") == F.col("_quad"), "left").withColumn("weak", F.col("_quad").isNotNull()).drop("_key", "_quad")
