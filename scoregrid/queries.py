"""Registered queries over the test tables, each with the DuckDB text of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import actions as A
from .operators import aggregate as G
from .operators import audit as D
from .operators import match as M
from .operators import metrics as E
from .operators import rank as H
from .operators import select as C
from .operators import shapes as P
from .plans import views as V
from .plans.winner import eligible_rows, kept, window_weights, winners
from .sources import shards as S
from .streaming import ops as T

TAIL, LEAST = 216_000, 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS = {"shards": V.SHARDS, "keys": V.KEYS, "gt": V.GT, "pred": V.PRED, "ae": V.ACTIONS, "commits": V.COMMITS, "fields": V.FIELDS, "manifest": V.MANIFEST}
_LATEST = "latest AS (SELECT * FROM (SELECT s.*, max(commit_block) OVER (PARTITION BY element_id, miner_hotkey) AS mc FROM shards s) WHERE commit_block = mc)"
_TAIL = f"{_LATEST}, tailed AS (SELECT l.*, (SELECT max(block) FROM latest) AS max_block FROM latest l WHERE block >= (SELECT max(block) FROM latest) - {TAIL})"
_ROWS = f"""{_TAIL}, marked AS (SELECT t.*, max(CASE WHEN abs(score) > 1e-12 THEN 1 ELSE 0 END) OVER w AS seen, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY block, seq) AS rn
  FROM tailed t WINDOW w AS (PARTITION BY element_id, miner_hotkey ORDER BY block, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rows_ AS (SELECT * FROM marked WHERE NOT (lane <> 'private' AND max_block - commit_block <= 21600 AND seen = 0 AND rn <= 5))"""
_MEANS = f"""{_ROWS}, means AS (SELECT element_id, uid, miner_hotkey, sum(score) AS total, count(*) AS n, avg(score) AS avg_score, min(block * 1000000 + seq) AS first_seen
  FROM rows_ GROUP BY ALL HAVING count(*) >= {LEAST})"""
_COMMIT = "mode_commit AS (SELECT element_id, miner_hotkey, commit_block FROM (SELECT element_id, miner_hotkey, commit_block, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY count(*) DESC, commit_block DESC) AS r FROM rows_ GROUP BY element_id, miner_hotkey, commit_block) WHERE r = 1)"


def query(sql: str | None = None, *views: str):
    """Decorator: registers a query and, given a text, its oracle; the named views are put before the text."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            head = ", ".join(f"{v} AS ({_VIEWS[v]})" for v in views)
            ORACLES[fn.__name__] = (f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}") if views else sql
        return fn

    return keep


def six(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


# the look-back and its winners


@query(f"WITH {_MEANS}, {_COMMIT}, best AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY avg_score DESC, first_seen) AS r FROM means) SELECT element_id, uid, miner_hotkey, round(avg_score, 6) AS avg_score, n, commit_block FROM best JOIN mode_commit USING (element_id, miner_hotkey) WHERE r = 1", "shards")
def winner_per_element(spark, d):
    return winners(V.shards(spark, d), TAIL, LEAST).select("element_id", "uid", "miner_hotkey", *six("avg_score"), "n", "commit_block")


_SIM = """maps_all AS (SELECT element_id, miner_hotkey, challenge_id, max_by(score, block * 1000000 + seq) AS score FROM rows_ GROUP BY ALL),
recent AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY block DESC, seq DESC) AS k FROM rows_ r) WHERE k <= 10),
maps_recent AS (SELECT element_id, miner_hotkey, challenge_id, max_by(score, block * 1000000 + seq) AS score FROM recent GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY avg_score DESC, first_seen) AS r FROM means) WHERE r = 1),
sim_all AS (SELECT a.element_id, b.miner_hotkey AS candidate FROM maps_all a JOIN best w ON a.element_id = w.element_id AND a.miner_hotkey = w.miner_hotkey JOIN maps_all b ON a.element_id = b.element_id AND a.challenge_id = b.challenge_id WHERE abs(a.score) > 1e-9 AND abs(b.score) > 1e-9 GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (abs(a.score - b.score) > greatest(0.05, 0.1 * greatest(abs(a.score), abs(b.score)))) < 2),
sim_recent AS (SELECT a.element_id, b.miner_hotkey AS candidate FROM maps_recent a JOIN best w ON a.element_id = w.element_id AND a.miner_hotkey = w.miner_hotkey JOIN maps_recent b ON a.element_id = b.element_id AND a.challenge_id = b.challenge_id WHERE abs(a.score) > 1e-9 AND abs(b.score) > 1e-9 GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (abs(a.score - b.score) > greatest(0.05, 0.1 * greatest(abs(a.score), abs(b.score)))) < 2),
alike AS (SELECT element_id, candidate FROM sim_recent JOIN sim_all USING (element_id, candidate) UNION SELECT element_id, miner_hotkey FROM best),
final AS (SELECT element_id, candidate AS final_hotkey, n_alike FROM (SELECT a.element_id, a.candidate, count(*) OVER (PARTITION BY a.element_id) AS n_alike, row_number() OVER (PARTITION BY a.element_id ORDER BY coalesce(commit_block, 1000000000000000000), a.candidate) AS r FROM alike a LEFT JOIN mode_commit c ON a.element_id = c.element_id AND a.candidate = c.miner_hotkey) WHERE r = 1)"""


@query(f"WITH {_MEANS}, {_COMMIT}, {_SIM} SELECT element_id, best.miner_hotkey, final_hotkey, n_alike FROM best JOIN final USING (element_id)", "shards")
def tiebreak_by_similarity(spark, d):
    rows = kept(eligible_rows(V.shards(spark, d), TAIL))
    means = G.mean_by_miner(rows).where(F.col("n") >= LEAST)
    out = H.tiebreak(rows, H.provisional_winner(means), G.mode_commit(rows, ("element_id", "miner_hotkey")), least_common=3)
    return out.select("element_id", "miner_hotkey", "final_hotkey", "n_alike")


@query(
    f"""WITH {_MEANS}, {_COMMIT}, {_SIM}, ranked AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY avg_score DESC, n DESC, uid) AS rank FROM means WHERE avg_score > 1e-12),
parts AS (SELECT m.uid, f.weight AS share FROM final JOIN means m ON final.element_id = m.element_id AND final.final_hotkey = m.miner_hotkey JOIN manifest f ON f.element_id = final.element_id WHERE track = 'public'
 UNION ALL SELECT uid, weight * CASE rank WHEN 1 THEN 0.80 WHEN 2 THEN 0.15 ELSE 0.05 END FROM ranked JOIN manifest USING (element_id) WHERE track = 'private' AND rank <= 3),
sums AS (SELECT uid, sum(share) AS w FROM parts GROUP BY uid), total AS (SELECT sum(w) AS t FROM sums)
SELECT uid, round(sum(w), 6) AS weight FROM (SELECT uid, w / greatest(t, 1.0) AS w FROM sums, total UNION ALL SELECT 0, greatest(1 - t, 0) FROM total WHERE t < 1) GROUP BY uid""",
    "shards", "manifest",
)
def weights_of_window(spark, d):
    return window_weights(V.shards(spark, d), V.manifest(spark, d), 0, TAIL, LEAST).select("uid", *six("weight"))


@query(f"WITH {_MEANS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY avg_score DESC, n DESC, uid) AS rank FROM means WHERE avg_score > 1e-12) SELECT element_id, rank, uid, n, round(avg_score, 6) AS avg_score, round(CASE rank WHEN 1 THEN 0.8 WHEN 2 THEN 0.15 ELSE 0.05 END * weight, 6) AS share FROM ranked JOIN manifest USING (element_id) WHERE rank <= 3", "shards", "manifest")
def ranked_private_shares(spark, d):
    means = G.mean_by_miner(eligible_rows(V.shards(spark, d), TAIL)).where(F.col("n") >= LEAST)
    return H.ranked_shares(H.top_rows(means, 3).join(V.manifest(spark, d), "element_id")).select("element_id", F.col("rank").cast("bigint").alias("rank"), "uid", "n", *six("avg_score", "share"))


# keys, filters and selections


@query("SELECT object_key, element_id, try_cast(split_part(split_part(object_key, '/', 6), '-', 1) AS BIGINT) AS key_block, split_part(object_key, '/', 2) AS key_element, split_part(object_key, '/', 3) AS key_miner, try_cast(split_part(object_key, '/', 4) AS BIGINT) AS key_commit, concat('block-', CAST(block // 300 * 300 AS VARCHAR)) AS window_id, concat('https://host/', object_key) AS url FROM keys", "keys")
def key_parts(spark, d):
    k = V.keys(spark, d)
    p = X.parse_key("object_key", "results")
    return k.select("object_key", "element_id", X.block_from_key("object_key").alias("key_block"), p["element"].alias("key_element"), p["miner"].alias("key_miner"), p["commit"].alias("key_commit"), X.window_id("block", 300).alias("window_id"), X.resolve_key(F.lit("https://host/a/index.json"), F.col("object_key"), "results").alias("url"))


@query("SELECT element_id, count(*) AS n, min(block) AS first_block, max(block) AS last_block FROM shards WHERE block >= (SELECT max(block) FROM shards) - 21600 GROUP BY element_id", "shards")
def look_back_tail(spark, d):
    return C.tail_filter(V.shards(spark, d), 21_600).groupBy("element_id").agg(F.count("*").alias("n"), F.min("block").alias("first_block"), F.max("block").alias("last_block"))


@query(f"WITH {_LATEST} SELECT element_id, miner_hotkey, commit_block, count(*) AS n FROM latest GROUP BY ALL", "shards")
def latest_commit_rows(spark, d):
    return C.latest_commit_filter(V.shards(spark, d)).groupBy("element_id", "miner_hotkey", "commit_block").agg(F.count("*").alias("n"))


@query(f"WITH {_ROWS} SELECT element_id, miner_hotkey, count(*) AS n, round(sum(score), 6) AS total FROM rows_ GROUP BY ALL", "shards")
def warmup_trimmed_totals(spark, d):
    return eligible_rows(V.shards(spark, d), TAIL).groupBy("element_id", "miner_hotkey").agg(F.count("*").alias("n"), F.sum("score").alias("total")).select("element_id", "miner_hotkey", "n", *six("total"))


@query("SELECT s.element_id, s.miner_hotkey, count(*) AS n FROM shards s WHERE NOT EXISTS (SELECT 1 FROM shards f WHERE f.latency_ms > 219 AND f.miner_hotkey = s.miner_hotkey AND f.element_id = s.element_id AND f.commit_block = s.commit_block) AND s.miner_hotkey NOT IN ('hk003', 'hk007') GROUP BY ALL", "shards")
def without_failed_and_blacklisted(spark, d):
    s = V.shards(spark, d)
    failed = C.failed_tuples(s.where("latency_ms > 219").select(F.col("miner_hotkey").alias("hotkey"), "element_id", "commit_block", F.col("challenge_id").alias("latest_run_key"))).withColumnRenamed("hotkey", "miner_hotkey")
    out = C.exclude_blacklist(C.exclude(s, failed, ("miner_hotkey", "element_id", "commit_block")), ["hk003"], spark.createDataFrame([("hk007",)], "hotkey string"))
    return out.groupBy("element_id", "miner_hotkey").agg(F.count("*").alias("n"))


@query("SELECT element_id, hotkey, max(block) AS block, max_by(model, block) AS model, max_by(revision, block) AS revision FROM commits WHERE role = 'miner' GROUP BY ALL", "commits")
def newest_commitments(spark, d):
    return C.latest_commit_for_element(V.commits(spark, d)).select("element_id", "hotkey", "block", "model", "revision")


@query("SELECT coalesce(a.element_id, b.element_id) AS element_id, coalesce(a.hotkey, b.hotkey) AS hotkey, coalesce(a.block, b.block) AS commit_block FROM (SELECT element_id, hotkey, max(block) AS block FROM commits WHERE role = 'miner' AND block >= 7040000 GROUP BY ALL) a FULL JOIN (SELECT element_id, hotkey, max(block) AS block FROM commits WHERE role = 'miner' AND block < 7040000 AND block >= 7001000 GROUP BY ALL) b ON a.element_id = b.element_id AND a.hotkey = b.hotkey", "commits")
def commit_blocks_with_history(spark, d):
    c = V.commits(spark, d)
    return C.commit_block_by_miner(c.where("block >= 7040000"), c.where("block < 7040000"), 7_001_000)


@query("WITH m AS (SELECT element_id, hotkey, max(block) AS block, max_by(model, block) AS model, max_by(revision, block) AS revision FROM commits WHERE role = 'miner' GROUP BY ALL) SELECT element_id, hotkey, model, revision, row_number() OVER w = 1 AS kept, first(hotkey) OVER w AS keeper FROM m WINDOW w AS (PARTITION BY model, revision ORDER BY block, hotkey)", "commits")
def registry_dedup(spark, d):
    return C.dedup_by_model_revision(C.latest_commit_for_element(V.commits(spark, d))).select("element_id", "hotkey", "model", "revision", "kept", "keeper")


@query("SELECT skip_reason, count(*) AS n FROM (SELECT CASE WHEN hotkey = 'hk004' THEN 'compliance' WHEN model = 'model3' THEN 'gated' WHEN revision = 'r2' THEN 'revision_mismatch' END AS skip_reason FROM commits WHERE role = 'miner') GROUP BY ALL", "commits")
def registry_skip_reasons(spark, d):
    rules = [("compliance", F.col("hotkey") == "hk004"), ("gated", F.col("model") == "model3"), ("revision_mismatch", F.col("revision") == "r2")]
    return C.registry_select(V.commits(spark, d).where("role = 'miner'"), rules).groupBy("skip_reason").agg(F.count("*").alias("n"))


@query("SELECT uid, miner_hotkey, element_id, count(*) AS n FROM (SELECT s.miner_hotkey, s.element_id, r.uid FROM shards s JOIN (SELECT miner_hotkey, min(uid) AS uid FROM shards WHERE block >= (SELECT max(block) - 216000 FROM shards) GROUP BY 1) r USING (miner_hotkey)) GROUP BY ALL", "shards")
def rows_of_registered_miners(spark, d):
    s = V.shards(spark, d)
    now = C.tail_filter(s, TAIL).select(F.col("miner_hotkey").alias("hotkey"), "uid")
    return C.with_uids(s, now).groupBy("uid", "miner_hotkey", "element_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT hotkey, element_id FROM commits c WHERE role = 'miner' AND EXISTS (SELECT 1 FROM shards s WHERE s.miner_hotkey = c.hotkey AND s.element_id = c.element_id)", "commits", "shards")
def miners_scored_before(spark, d):
    miners = V.commits(spark, d).where("role = 'miner'").select(F.col("hotkey").alias("miner_hotkey"), "element_id").distinct()
    return C.prior_scored(miners, V.shards(spark, d)).select(F.col("miner_hotkey").alias("hotkey"), "element_id")


@query("SELECT object_key, CAST(commit_block AS BIGINT) AS commit_block FROM keys WHERE element_id = (SELECT min(element_id) FROM keys)", "keys")
def keys_of_an_element(spark, d):
    k = V.keys(spark, d)
    first = k.agg(F.min("element_id").alias("first"))
    below = X.element_in_key("object_key", "results", F.col("first"))
    return k.crossJoin(F.broadcast(first)).where(below).select("object_key", X.sample_commit("results", F.lit(None).cast("string"), F.col("object_key")).alias("commit_block"))  # one row


@query("WITH v AS (SELECT block AS from_block, max(model) AS version FROM commits WHERE role = 'central_validator' GROUP BY block) SELECT q.block, coalesce((SELECT max(from_block) FROM v WHERE v.from_block <= q.block), (SELECT max(from_block) FROM v)) AS from_block FROM (SELECT DISTINCT block FROM commits WHERE role = 'miner') q", "commits")
def manifest_as_of(spark, d):
    c = V.commits(spark, d)
    versions = c.where("role = 'central_validator'").groupBy(F.col("block").alias("from_block")).agg(F.max("model").alias("version"))
    return C.as_of(c.where("role = 'miner'").select("block").distinct(), versions).select("block", "from_block")


@query("SELECT element_id, miner_hotkey, seq FROM (SELECT s.*, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY sha256(concat('w1:', challenge_id)), challenge_id, seq) AS r FROM (SELECT *, row_number() OVER (PARTITION BY element_id, miner_hotkey, challenge_id ORDER BY block, seq) AS u FROM shards WHERE score > 0) s WHERE u = 1) WHERE r <= 4", "shards")
def audit_sample(spark, d):
    s = V.shards(spark, d).withColumn("responses_key", F.col("challenge_id"))
    return C.challenge_sample_per_target(s, "w1", 4, ("element_id", "miner_hotkey")).select("element_id", "miner_hotkey", "seq")


@query("SELECT element_id, miner_hotkey, commit_block, count(*) AS n, max(block) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY element_id, miner_hotkey, commit_block ORDER BY block DESC, seq DESC) AS r FROM shards) WHERE r > 10 GROUP BY ALL", "shards")
def audit_candidate_rows(spark, d):
    return C.audit_candidates(V.shards(spark, d)).groupBy("element_id", "miner_hotkey", "commit_block").agg(F.count("*").alias("n"), F.max("block").alias("newest"))


@query("SELECT element_id, miner_hotkey, challenge_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY block // 7200, miner_hotkey, element_id, challenge_id ORDER BY validator_hotkey, seq) AS r FROM shards) WHERE r = 1", "shards")
def window_dedup(spark, d):
    s = V.shards(spark, d).withColumn("window_id", X.window_id("block", 7200))
    return C.window_shard_dedup(s).select("element_id", "miner_hotkey", "challenge_id", "seq")


@query("SELECT challenge_id, sha256(concat('w9:', challenge_id)) AS rank_hash FROM (SELECT DISTINCT challenge_id FROM shards) ORDER BY rank_hash LIMIT 10", "shards")
def historical_challenges(spark, d):
    return C.historical_sample(V.shards(spark, d).select("challenge_id").distinct(), "w9", 10)


# aggregates


@query("SELECT element_id, miner_hotkey, latency_ms AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY element_id, miner_hotkey) AS n FROM shards) WHERE r = CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1", "shards")
def p95_latency(spark, d):
    return G.p95_index(V.shards(spark, d), ("element_id", "miner_hotkey"), "latency_ms")


@query("WITH p AS (SELECT element_id, miner_hotkey, latency_ms AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY element_id, miner_hotkey) AS n FROM shards) WHERE r = CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1) SELECT element_id, miner_hotkey, round(p95 / 10000 * 5, 6) AS rtf, p95 / 10000 * 5 <= 1 AS passed FROM p", "shards")
def rtf_by_miner(spark, d):
    p = G.p95_index(V.shards(spark, d), ("element_id", "miner_hotkey"), "latency_ms")
    return p.select("element_id", "miner_hotkey", X.rtf("p95", 25).alias("rtf"), X.rtf_gate("p95", F.lit(25)).alias("passed")).select("element_id", "miner_hotkey", *six("rtf"), "passed")


@query("WITH r AS (SELECT element_id, score, CAST(latency_ms AS DOUBLE) AS w, seq, sum(latency_ms) OVER (PARTITION BY element_id ORDER BY score RANGE UNBOUNDED PRECEDING) AS c, sum(latency_ms) OVER (PARTITION BY element_id) AS t FROM shards) SELECT element_id, round(min(score) FILTER (w > 0 AND c >= t / 2), 6) AS median FROM r GROUP BY element_id", "shards")
def weighted_median_score(spark, d):
    return G.weighted_median(V.shards(spark, d), ("element_id",), "score", "latency_ms").select("element_id", *six("median"))


@query("SELECT miner_hotkey, round(sum(score), 6) AS total, count(*) AS n FROM shards WHERE NOT coalesce(timed_out, false) GROUP BY miner_hotkey", "shards")
def private_totals(spark, d):
    return G.private_aggregate(V.shards(spark, d)).select("miner_hotkey", *six("total"), "n")


@query("SELECT element_id, miner_hotkey, challenge_id, round(max_by(score, block * 1000000 + seq), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY block DESC, seq DESC) AS k FROM shards) WHERE k <= 10 GROUP BY ALL", "shards")
def recent_challenge_map(spark, d):
    return G.challenge_map(V.shards(spark, d), recent=10).select("element_id", "miner_hotkey", "challenge_id", *six("score"))


@query("SELECT element_id, miner_hotkey, commit_block FROM (SELECT element_id, miner_hotkey, commit_block, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY count(*) DESC, commit_block DESC) AS r FROM shards GROUP BY element_id, miner_hotkey, commit_block) WHERE r = 1", "shards")
def mode_commits(spark, d):
    return G.mode_commit(V.shards(spark, d), ("element_id", "miner_hotkey"))


@query("SELECT reason, count(*) AS n, count(DISTINCT validator_hotkey) AS n_sources FROM (SELECT *, CASE WHEN timed_out THEN 'timed_out' WHEN score = 0 THEN 'zero' ELSE 'accepted' END AS reason FROM shards) GROUP BY reason", "shards")
def reject_reasons(spark, d):
    return G.reject_diagnostics(V.shards(spark, d).withColumn("reason", F.when(F.col("timed_out"), "timed_out").when(F.col("score") == 0, "zero").otherwise("accepted")))


@query("WITH m AS (SELECT element_id, median(score) AS med FROM shards GROUP BY 1), x AS (SELECT s.*, abs(score - med) AS dev FROM shards s JOIN m USING (element_id)), y AS (SELECT element_id, median(dev) AS mad FROM x GROUP BY 1) SELECT element_id, round(sum(score * latency_ms) / sum(latency_ms), 6) AS mean, count(*) AS n_kept FROM x JOIN y USING (element_id) WHERE dev <= 2 * mad GROUP BY 1", "shards")
def mad_pruned_mean(spark, d):
    return G.mad_prune(V.shards(spark, d), ("element_id",), "score", "latency_ms", 2.0).select("element_id", *six("mean"), "n_kept")


_UNITS = "CAST(floor({} / 1e-9 + 0.5) AS HUGEINT)"
_MEAN = "round((2 * sum({}) + 1000 * count(*)) // (2000 * count(*)) * 1e-6, 6)"


@query(f"WITH v AS (SELECT block // 7200 * 7200 AS start, element_id, miner_hotkey, {_UNITS.format('score')} AS s, {_UNITS.format('(beta * greatest(greatest(score - theta, 0), delta_floor))')} AS p FROM shards JOIN manifest USING (element_id)) SELECT start, element_id, miner_hotkey, count(*) AS n, {_MEAN.format('s')} AS avg_score, {_MEAN.format('p')} AS paid FROM v GROUP BY ALL", "shards", "manifest")
def clip_means_by_window(spark, d):
    s = V.shards(spark, d).join(F.broadcast(V.manifest(spark, d)), "element_id").withColumns({"avg_score": F.col("score"), "paid": X.economic_score(F.col("score"), F.col("theta"), F.col("delta_floor"), F.col("beta"))})
    return G.clip_means(s, 7200, ("avg_score", "paid")).select("start", "element_id", "miner_hotkey", "n", *six("avg_score", "paid"))


@query("WITH r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY element_id, miner_hotkey) AS n FROM shards WINDOW w AS (PARTITION BY element_id, miner_hotkey ORDER BY block, seq)) SELECT element_id, miner_hotkey, round(sum(score * power(power(2.0, -1.0 / 20), n - k) * CASE WHEN k = 1 THEN 1 ELSE 1 - power(2.0, -1.0 / 20) END), 6) AS ewma, max(n) AS n FROM r GROUP BY ALL", "shards")
def ewma_scores(spark, d):
    return H.ewma(V.shards(spark, d), ("element_id", "miner_hotkey"), ("block", "seq"), "score", 20).select("element_id", "miner_hotkey", *six("ewma"), "n")


@query("WITH m AS (SELECT element_id, uid, avg(score) AS a FROM shards GROUP BY ALL), s AS (SELECT element_id, uid, weight * a / sum(a) OVER (PARTITION BY element_id) AS share FROM m JOIN manifest USING (element_id)) SELECT element_id, uid, round(share, 6) AS share, round(CASE WHEN share > 0.02 THEN 0.02 + (share - 0.02) * 0.5 ELSE share END, 6) AS guarded FROM s", "shards", "manifest")
def guarded_shares(spark, d):
    m = V.shards(spark, d).groupBy("element_id", "uid").agg(F.avg("score").alias("avg_score")).join(V.manifest(spark, d), "element_id")
    out = H.miner_share(m)
    return out.withColumn("guarded", H.concentration_guard(F.col("share"), 0.02, 0.5)).select("element_id", "uid", *six("share", "guarded"))


@query("WITH s AS (SELECT element_id, miner_hotkey, commit_block, seq, block, CASE WHEN latency_ms <= 100 THEN 1 ELSE 0 END AS ok FROM shards), i AS (SELECT *, sum(ok) OVER (PARTITION BY element_id, miner_hotkey ORDER BY block, seq ROWS UNBOUNDED PRECEDING) AS g FROM s), t AS (SELECT *, CASE WHEN ok = 1 THEN 0 ELSE sum(1 - ok) OVER (PARTITION BY element_id, miner_hotkey, g ORDER BY block, seq ROWS UNBOUNDED PRECEDING) END AS streak FROM i) SELECT seq, CAST(streak AS BIGINT) AS streak, CASE WHEN streak = 0 THEN 'PASS' WHEN streak >= 3 THEN 'FAIL_LATENCY' ELSE 'PENDING_LATENCY' END AS status FROM t", "shards")
def latency_streaks(spark, d):
    return D.latency_streak(V.shards(spark, d), ("element_id", "miner_hotkey"), F.col("latency_ms") <= 100, ("block", "seq")).select("seq", "streak", "status")


@query("WITH c AS (SELECT max(block) - 30 * 7200 + 200000 AS cut FROM keys) SELECT DISTINCT object_key AS key, CASE WHEN block < (SELECT max(block) - 15 * 7200 FROM keys) THEN 'archive' ELSE 'index' END AS place FROM keys", "keys")
def compacted_index(spark, d):
    k = V.keys(spark, d).select(F.col("object_key").alias("key"), "block")
    return D.compact_index(k, k.limit(0).select("key"), 15)


@query("WITH t AS (SELECT element_id, miner_hotkey, max(commit_block) AS commit_block FROM shards GROUP BY ALL), now AS (SELECT element_id, hotkey AS miner_hotkey, max(block) AS current_commit FROM commits WHERE role = 'miner' GROUP BY ALL) SELECT element_id, miner_hotkey, commit_block, current_commit, CASE WHEN current_commit IS NULL THEN 'current_commitment_missing' WHEN current_commit <> commit_block THEN 'new_commit_block' ELSE 'ok' END AS status FROM t LEFT JOIN now USING (element_id, miner_hotkey)", "shards", "commits")
def resolved_targets(spark, d):
    t = V.shards(spark, d).groupBy("element_id", "miner_hotkey").agg(F.max("commit_block").alias("commit_block"))
    return D.resolve_target_commit(t, C.latest_commit_for_element(V.commits(spark, d))).select("element_id", "miner_hotkey", "commit_block", "current_commit", "status")


# scalar rules


@query("SELECT seq, round(CASE WHEN score = 0 AND latency_ms = 0 THEN 1 WHEN score = 0 OR latency_ms = 0 THEN 0 ELSE greatest(0, 1 - abs(score - latency_ms / 200) / greatest(abs(score), abs(latency_ms / 200))) END, 6) AS pct, abs(score - latency_ms / 200) <= 1 - 0.8 AS close FROM shards", "shards")
def score_agreement(spark, d):
    s = V.shards(spark, d).withColumn("other", F.col("latency_ms") / 200)
    return s.select("seq", X.match_percentage(F.col("score"), F.col("other")).alias("pct"), X.scores_match_absolute(F.col("score"), F.col("other"), 0.8).alias("close")).select("seq", *six("pct"), "close")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) END AS host, regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(jpe?g|png|webp|bmp|gif)$') AS image FROM pages")
def page_addresses(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.when(F.col("url").rlike("^https?://"), F.lower(F.try_parse_url("url", F.lit("HOST")))).alias("host"), X.looks_like_image(F.col("url")).alias("image"))


@query("WITH p AS (SELECT vec_id, i, CAST(floor(CAST(embedding[2*i+1] AS DOUBLE)*2000+400) AS BIGINT) AS x, CAST(floor(CAST(embedding[2*i+2] AS DOUBLE)*1200+250) AS BIGINT) AS y FROM embeddings, (SELECT unnest(range(32)) AS i)), q AS (SELECT vec_id, CASE WHEN x >= 0 AND y >= 0 AND x < 960 AND y < 540 THEN x ELSE 0 END AS x, CASE WHEN x >= 0 AND y >= 0 AND x < 960 AND y < 540 THEN y ELSE 0 END AS y FROM p) SELECT vec_id, count(*) FILTER (x <> 0 OR y <> 0) AS n, count(*) FILTER (x <> 0 OR y <> 0) >= 4 AS ok FROM q GROUP BY vec_id")
def screened_keypoints(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.floor(F.get("embedding", 2 * i).cast("double") * 2000 + 400).alias("x"), F.floor(F.get("embedding", 2 * i + 1).cast("double") * 1200 + 250).alias("y")))
    s = e.withColumn("s", X.keypoint_screen(pts))
    return s.select("vec_id", F.col("s.n").cast("bigint").alias("n"), F.col("s.ok").alias("ok"))


_LIVE = "p AS (SELECT vec_id, i, (vec_id % 36 < 18 AND list_contains(QUADS[CAST(vec_id % 36 AS INT) + 1], i)) OR (vec_id % 36 >= 18 AND (i * 7 + vec_id) % 8 = 0) AS live, greatest(1, least(959, CAST(floor(CAST(embedding[i] AS DOUBLE) * 2000 + 400) AS BIGINT))) AS x, greatest(1, least(539, CAST(floor(CAST(embedding[i + 32] AS DOUBLE) * 1200 + 250) AS BIGINT))) AS y FROM embeddings, (SELECT unnest(range(1, 33)) AS i))".replace("QUADS", str(C.WEAK_QUADS))
_LINES_OF_POINTS = [(1, 2), (7, 8), (12, 13), (20, 29), (3, 11), (23, 24)]
_NEAR = "CASE WHEN {0}.x <= 100 AND {1}.x <= 100 OR {0}.x >= 860 AND {1}.x >= 860 OR {0}.y <= 100 AND {1}.y <= 100 OR {0}.y >= 440 AND {1}.y >= 440 THEN 1 ELSE 0 END".format("a", "b")


@query(f"WITH {_LIVE}, l AS (SELECT vec_id, list(i ORDER BY i) FILTER (live) AS s, count(*) FILTER (live) AS n FROM p GROUP BY 1), q AS (SELECT DISTINCT list_sort(unnest({C.WEAK_QUADS})) AS s), n AS (SELECT a.vec_id, sum({_NEAR}) AS near FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.live AND b.live JOIN (SELECT unnest({[list(x) for x in _LINES_OF_POINTS]}) AS ab) t ON a.i = ab[1] AND b.i = ab[2] GROUP BY 1) SELECT l.vec_id, n, q.s IS NOT NULL AS weak, coalesce(near, 0) AS near_pairs FROM l LEFT JOIN q ON q.s = l.s AND n = 4 LEFT JOIN n ON n.vec_id = l.vec_id")
def weak_keypoint_frames(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    quads = F.array(*[F.array(*[F.lit(i) for i in q]) for q in C.WEAK_QUADS])
    k = (F.col("vec_id") % 36).cast("int")
    live = lambda i: ((k < 18) & F.array_contains(F.get(quads, k), i)) | ((k >= 18) & ((i * 7 + F.col("vec_id")) % 8 == 0))
    x = lambda i: F.greatest(F.lit(1), F.least(F.lit(959), F.floor(F.get("embedding", i - 1).cast("double") * 2000 + 400)))
    y = lambda i: F.greatest(F.lit(1), F.least(F.lit(539), F.floor(F.get("embedding", i + 31).cast("double") * 1200 + 250)))
    pts = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.struct(F.when(live(i), x(i)).otherwise(0).alias("x"), F.when(live(i), y(i)).otherwise(0).alias("y")))
    marked = C.mark_weak_quads(e.select("vec_id", pts.alias("points")), C.weak_quads(spark))
    return marked.select("vec_id", F.size(X.live_places(F.col("points"))).cast("bigint").alias("n"), "weak", F.size(X.same_edge_pairs(F.col("points"), _LINES_OF_POINTS)).cast("bigint").alias("near_pairs"))


# boxes

_IOU = "CASE WHEN least(a.x2, b.x2) <= greatest(a.x1, b.x1) OR least(a.y2, b.y2) <= greatest(a.y1, b.y1) THEN 0.0 ELSE CAST((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) END"


@query(f"SELECT a.run_id, a.frame, a.cls, a.det_ord AS gt_ord, b.det_ord AS pred_ord, round({_IOU}, 6) AS iou FROM gt a JOIN pred b ON a.run_id = b.run_id AND a.frame = b.frame AND a.cls = b.cls WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)", "gt", "pred")
def overlapping_pairs(spark, d):
    box = F.struct("x1", "y1", "x2", "y2")
    g = V.gt(spark, d).select("run_id", "frame", "cls", F.col("det_ord").alias("gt_ord"), box.alias("a"))
    p = V.pred(spark, d).select("run_id", "frame", "cls", F.col("det_ord").alias("pred_ord"), box.alias("b"))
    return g.join(p, ["run_id", "frame", "cls"]).withColumn("iou", X.box_iou(F.col("a"), F.col("b"))).where("iou > 0").select("run_id", "frame", "cls", "gt_ord", "pred_ord", *six("iou"))


@query("SELECT run_id, frame, det_ord, round(CASE WHEN r <= 0.0005 THEN 0.3 WHEN r <= 0.01 THEN 0.3 + 0.2 * (log10(r) - log10(0.0005)) / (log10(0.01) - log10(0.0005)) WHEN r <= 0.05 THEN 0.5 WHEN r <= 0.25 THEN 0.5 + 0.2 * (log10(r) - log10(0.05)) / (log10(0.25) - log10(0.05)) ELSE 0.7 END, 6) AS bar FROM (SELECT *, (x2 - x1) * (y2 - y1) / 518400.0 AS r FROM gt)", "gt")
def adaptive_bars(spark, d):
    return V.gt(spark, d).select("run_id", "frame", "det_ord", X.adaptive_iou_bar(F.struct("x1", "y1", "x2", "y2")).alias("bar")).select("run_id", "frame", "det_ord", *six("bar"))


def _greedy_sql(bar: str) -> str:
    """The fold as a recursive query: step k takes the k-th prediction of each (run, class, frame)."""
    return f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY run_id, cls, frame ORDER BY score DESC, det_ord) AS k FROM pred),
g AS (SELECT run_id, cls, frame, list({{'o': det_ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY det_ord) AS boxes FROM gt GROUP BY ALL),
pairs AS (SELECT a.run_id, a.cls, a.frame, a.k, b.i, b.b AS box, a.det_ord, a.score, {_IOU.replace('b.x', 'b.b.x').replace('b.y', 'b.b.y')} AS iou FROM p a JOIN (SELECT run_id, cls, frame, unnest(boxes) AS b, generate_subscripts(boxes, 1) AS i FROM g) b ON a.run_id = b.run_id AND a.cls = b.cls AND a.frame = b.frame),
cand AS (SELECT run_id, cls, frame, k, list({{'v': iou, 'i': -i, 'r': (box.x2 - box.x1) * (box.y2 - box.y1) / 518400.0}} ORDER BY iou DESC, i) AS c FROM pairs GROUP BY ALL),
st AS (SELECT run_id, cls, frame, 0::BIGINT AS k, []::BIGINT[] AS used, false AS tp, 0.0::DOUBLE AS v FROM (SELECT DISTINCT run_id, cls, frame FROM p)
 UNION ALL SELECT s.run_id, s.cls, s.frame, s.k + 1, CASE WHEN hit THEN list_append(used, i) ELSE used END, hit, CASE WHEN hit THEN w ELSE 0 END FROM (SELECT s.*, -(best.i) AS i, best.v AS w, coalesce(best.v > 0 AND best.v >= {bar}, false) AS hit FROM (SELECT s.*, list_filter(cand.c, lambda x: NOT list_contains(s.used, -(x.i)))[1] AS best FROM st s JOIN p ON p.run_id = s.run_id AND p.cls = s.cls AND p.frame = s.frame AND p.k = s.k + 1 LEFT JOIN cand ON cand.run_id = s.run_id AND cand.cls = s.cls AND cand.frame = s.frame AND cand.k = s.k + 1) s) s),
m AS (SELECT p.run_id, p.cls, p.frame, p.det_ord, p.score, st.tp, st.v FROM st JOIN p USING (run_id, cls, frame, k))"""


_BAR = "CASE WHEN best.r <= 0.0005 THEN 0.3 WHEN best.r <= 0.01 THEN 0.3 + 0.2 * (log10(best.r) - log10(0.0005)) / (log10(0.01) - log10(0.0005)) WHEN best.r <= 0.05 THEN 0.5 WHEN best.r <= 0.25 THEN 0.5 + 0.2 * (log10(best.r) - log10(0.05)) / (log10(0.25) - log10(0.05)) ELSE 0.7 END"


def _recursive(text: str) -> str:
    return f"WITH RECURSIVE gt AS ({V.GT}), pred AS ({V.PRED}), " + text[len("WITH RECURSIVE ") :]


@query()
def greedy_matches(spark, d):
    return M.greedy_match(V.gt(spark, d), V.pred(spark, d))


@query()
def greedy_matches_constant(spark, d):
    return M.greedy_match(V.gt(spark, d), V.pred(spark, d), 0.5)


@query()
def detection_precision_recall(spark, d):
    g = V.gt(spark, d)
    return E.precision_recall(M.greedy_match(g, V.pred(spark, d)), g).select("run_id", "tp", "fp", "n_gt", *six("precision", "recall", "false_positive"))


@query()
def detection_average_precision(spark, d):
    g = V.gt(spark, d)
    return E.average_precision(M.greedy_match(g, V.pred(spark, d)), g).select("run_id", "cls", *six("ap"))


@query()
def class_report(spark, d):
    g = V.gt(spark, d)
    return E.per_class_report(M.greedy_match(g, V.pred(spark, d)), g).select("run_id", "cls", "n_gt", "n_pred", "tp", "fp", "fn", *six("precision", "recall", "f1", "ap"))


@query()
def detection_map(spark, d):
    g = V.gt(spark, d)
    return E.mean_average_precision(E.average_precision(M.greedy_match(g, V.pred(spark, d)), g)).select("run_id", *six("map"))


_AP = "n AS (SELECT run_id, cls, count(*) AS n_gt FROM gt GROUP BY ALL), r1 AS (SELECT m.*, n_gt, sum(CASE WHEN tp THEN 1 ELSE 0 END) OVER w AS c, count(*) OVER w AS k FROM m JOIN n USING (run_id, cls) WINDOW w AS (PARTITION BY run_id, cls ORDER BY score DESC, frame, det_ord ROWS UNBOUNDED PRECEDING)), r2 AS (SELECT *, c / k AS p, c / n_gt AS r FROM r1), r3 AS (SELECT *, max(p) OVER (PARTITION BY run_id, cls ORDER BY score DESC, frame, det_ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e, coalesce(lag(r) OVER (PARTITION BY run_id, cls ORDER BY score DESC, frame, det_ord), 0) AS b FROM r2), ap AS (SELECT n.run_id, n.cls, coalesce(sum((r - b) * e), 0) AS ap FROM n LEFT JOIN r3 ON n.run_id = r3.run_id AND n.cls = r3.cls GROUP BY ALL)"
ORACLES |= {
    "greedy_matches": _recursive(_greedy_sql(_BAR)) + " SELECT run_id, cls, frame, det_ord, score, tp FROM m",
    "greedy_matches_constant": _recursive(_greedy_sql("0.5")) + " SELECT run_id, cls, frame, det_ord, score, tp FROM m",
    "detection_precision_recall": _recursive(_greedy_sql(_BAR)) + ", h AS (SELECT run_id, count(*) FILTER (tp) AS tp, count(*) FILTER (NOT tp) AS fp FROM m GROUP BY 1), n AS (SELECT run_id, count(*) AS n_gt, count(DISTINCT frame) AS f FROM gt GROUP BY 1) SELECT run_id, tp, fp, n_gt, round(tp / (tp + fp), 6) AS precision, round(tp / n_gt, 6) AS recall, round(greatest(0, 1 - fp / f / 10), 6) AS false_positive FROM n JOIN h USING (run_id)",
    "detection_average_precision": _recursive(_greedy_sql(_BAR)) + f", {_AP} SELECT run_id, cls, round(ap, 6) AS ap FROM ap",
    "class_report": _recursive(_greedy_sql(_BAR)) + f", {_AP}, h AS (SELECT run_id, cls, count(*) AS n_pred, count(*) FILTER (tp) AS tp FROM m GROUP BY ALL), b AS (SELECT run_id, cls, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM n FULL JOIN h USING (run_id, cls)) SELECT run_id, cls, n_gt, n_pred, tp, n_pred - tp AS fp, n_gt - tp AS fn, round(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END, 6) AS precision, round(CASE WHEN n_gt > 0 THEN tp / n_gt ELSE 0 END, 6) AS recall, round(2.0 * tp / (n_gt + n_pred), 6) AS f1, round(ap, 6) AS ap FROM b LEFT JOIN ap USING (run_id, cls)",
    "detection_map": _recursive(_greedy_sql(_BAR)) + f", {_AP} SELECT run_id, round(avg(ap), 6) AS map FROM ap GROUP BY run_id",
}


@query()
def placement_f1(spark, d):
    return E.placement(V.gt(spark, d), V.pred(spark, d)).select("run_id", *six("score"))


@query()
def label_strict_f1(spark, d):
    return E.label_f1(V.gt(spark, d), V.pred(spark, d)).select("run_id", *six("score"))


# an element of the pillars that shared intermediates give, against its weights; precision, recall and mAP have an oracle
_PILLAR_WEIGHTS = {"precision": 0.2, "recall": 0.3, "false_positive": 0.1, "map": 0.4}
_ELEMENT = _recursive(_greedy_sql(_BAR)) + f""", {_AP}, h AS (SELECT run_id, count(*) FILTER (tp) AS tp, count(*) FILTER (NOT tp) AS fp FROM m GROUP BY 1), c AS (SELECT run_id, count(*) AS n_gt, count(DISTINCT frame) AS f FROM gt GROUP BY 1),
z AS (SELECT run_id, tp / (tp + fp) AS p, tp / c.n_gt AS r, greatest(0, 1 - fp / f / 10) AS q, (SELECT avg(ap) FROM ap WHERE ap.run_id = c.run_id) AS a FROM c JOIN h USING (run_id))
SELECT run_id, round(p + r + q + a, 6) AS score, round(0.2 * p + 0.3 * r + 0.1 * q + 0.4 * a, 6) AS weighted, round(1.4 * greatest(greatest(0.2 * p + 0.3 * r + 0.1 * q + 0.4 * a - 0.5, 0), 0.0), 6) AS paid FROM z"""


@query(_ELEMENT)
def element_score_of_runs(spark, d):
    found = E.element_pillars("Detect", list(_PILLAR_WEIGHTS), V.gt(spark, d), V.pred(spark, d)).withColumn("element_id", F.lit("ns/Detect-error"))
    weights = spark.createDataFrame([("ns/Detect-error", p, w) for p, w in _PILLAR_WEIGHTS.items()], "element_id string, pillar string, weight double")
    return E.element_scores(found, weights, V.manifest(spark, d)).select("run_id", *six("score", "weighted", "paid"))


@query()
def output_comparison(spark, d):
    return M.compare_outputs(V.gt(spark, d), V.pred(spark, d)).select("run_id", "frame", "n_expected", "n_actual", "matched", *six("mean_iou"), "passed")


@query()
def output_verdicts(spark, d):
    g = V.gt(spark, d)
    return M.comparison_verdicts(M.compare_outputs(g, V.pred(spark, d)), g).select("run_id", "reason", "passed", *six("mean_iou", "matched_mean_iou"), "missing", "extra", *six("missing_ratio", "extra_ratio"), "frames_compared")


# expected boxes take actual ones: the same fold with the sides changed, in expected order
_COMPARED = f"WITH RECURSIVE gt AS ({V.PRED}), pred AS (SELECT * EXCLUDE (score), 0.0 AS score FROM (SELECT *, 0.0 AS score FROM ({V.GT}))), " + _greedy_sql("0").replace("WITH RECURSIVE ", "") + """,
ex AS (SELECT run_id, frame, count(*) AS ne FROM pred GROUP BY ALL), ac AS (SELECT run_id, frame, count(*) AS na FROM gt GROUP BY ALL), hits AS (SELECT run_id, frame, count(*) FILTER (tp) AS nm, sum(v) AS s FROM m GROUP BY ALL),
fr AS (SELECT run_id, frame, ne, na, nm, s, s / ne AS mean FROM ex JOIN ac USING (run_id, frame) JOIN hits USING (run_id, frame))"""
ORACLES |= {
    "output_comparison": _COMPARED + " SELECT run_id, frame, ne AS n_expected, na AS n_actual, nm AS matched, round(mean, 6) AS mean_iou, mean >= 0.95 AS passed FROM fr",
    "output_verdicts": _COMPARED + ", t AS (SELECT run_id, avg(mean) AS mi, sum(s) AS s, sum(nm) AS m, sum(ne - nm) AS missing, sum(na - nm) AS extra, sum(ne) AS ne, sum(na) AS na, count(*) AS fc FROM fr GROUP BY 1) SELECT r.run_id, CASE WHEN fc IS NULL THEN 'no_common_frames' END AS reason, coalesce(mi >= 0.95, false) AS passed, round(mi, 6) AS mean_iou, round(CASE WHEN m > 0 THEN s / m ELSE 0 END, 6) AS matched_mean_iou, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, round(coalesce(missing, 0) / greatest(coalesce(ne, 0), 1), 6) AS missing_ratio, round(coalesce(extra, 0) / greatest(coalesce(na, 0), 1), 6) AS extra_ratio, coalesce(fc, 0) AS frames_compared FROM (SELECT DISTINCT run_id FROM pred) r LEFT JOIN t USING (run_id)",
}


# shapes of boxes and polygons, met by enumerated pixels


def _pixels(name: str) -> str:
    """The pixels of each row of `name`: nearest pixels of its edges, and those between pairs of crossings."""
    outline = ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in V.OUTLINE)
    return f"""{name}_e AS (SELECT run_id, frame, cls, det_ord, unnest(list_transform(range(1, len(pts) + 1), lambda i: {{'p': pts[i], 'q': pts[i % len(pts) + 1]}})) AS e FROM (SELECT *, CASE WHEN has_polygon THEN [{outline}] ELSE [{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x1, 'y': y2}}] END AS pts FROM {name})),
{name}_f AS (SELECT * EXCLUDE (e), e.p.x AS xa, e.p.y AS ya, e.q.x AS xb, e.q.y AS yb FROM {name}_e),
{name}_c AS (SELECT run_id, frame, cls, det_ord, y, CAST(floor(xa + (y - ya) * (xb - xa) / (yb - ya) + 0.5) AS BIGINT) AS x FROM (SELECT *, unnest(range(least(ya, yb), greatest(ya, yb))) AS y FROM {name}_f WHERE ya <> yb)),
{name}_i AS (SELECT run_id, frame, cls, det_ord, y, unnest(range(x, nx + 1)) AS x FROM (SELECT *, lead(x) OVER w AS nx, row_number() OVER w AS k FROM {name}_c WINDOW w AS (PARTITION BY run_id, frame, cls, det_ord, y ORDER BY x)) WHERE k % 2 = 1 AND nx IS NOT NULL),
{name}_b AS (SELECT run_id, frame, cls, det_ord, y, CASE WHEN ya = yb THEN xa ELSE CAST(floor(xa + (y - ya) * (xb - xa) / (yb - ya) + 0.5) AS BIGINT) END AS x FROM (SELECT *, unnest(range(least(ya, yb), greatest(ya, yb) + 1)) AS y FROM {name}_f WHERE abs(yb - ya) >= abs(xb - xa))
 UNION ALL SELECT run_id, frame, cls, det_ord, CAST(floor(ya + (x - xa) * (yb - ya) / (xb - xa) + 0.5) AS BIGINT), x FROM (SELECT *, unnest(range(least(xa, xb), greatest(xa, xb) + 1)) AS x FROM {name}_f WHERE abs(yb - ya) < abs(xb - xa))),
{name}_p AS MATERIALIZED (SELECT DISTINCT run_id, frame, cls, det_ord, x, y FROM (SELECT run_id, frame, cls, det_ord, x, y FROM {name}_i UNION ALL SELECT run_id, frame, cls, det_ord, x, y FROM {name}_b)),
{name}_n AS MATERIALIZED (SELECT run_id, frame, cls, det_ord, count(*) AS n FROM {name}_p GROUP BY ALL)"""


def _shapes_sql(gt: str, pred: str, bar: str) -> str:
    """The fold over shapes: pairs of boxes by area, other pairs by shared pixels."""
    fold = _greedy_sql(bar)
    formula = _IOU.replace("b.x", "b.b.x").replace("b.y", "b.b.y")
    fold = fold.replace(formula, f"CASE WHEN a.has_polygon OR b.b.h THEN coalesce(px.iou, 0.0) ELSE {formula} END").replace("'y2': y2} ORDER", "'y2': y2, 'h': has_polygon} ORDER")
    fold = fold.replace("AND a.frame = b.frame),", "AND a.frame = b.frame LEFT JOIN px ON px.run_id = a.run_id AND px.cls = a.cls AND px.frame = a.frame AND px.pred = a.det_ord AND px.truth = b.b.o),", 1)
    shared = "ov AS (SELECT a.run_id, a.frame, a.cls, a.det_ord AS truth, b.det_ord AS pred, count(*) AS n FROM gt_p a JOIN pred_p b USING (run_id, frame, cls, x, y) GROUP BY ALL), px AS MATERIALIZED (SELECT ov.run_id, ov.frame, ov.cls, truth, pred, ov.n / (g.n + p.n - ov.n) AS iou FROM ov JOIN gt_n g ON g.run_id = ov.run_id AND g.frame = ov.frame AND g.cls = ov.cls AND g.det_ord = truth JOIN pred_n p ON p.run_id = ov.run_id AND p.frame = ov.frame AND p.cls = ov.cls AND p.det_ord = pred)"
    return f"WITH RECURSIVE gt AS ({gt}), pred AS ({pred}), {_pixels('gt')}, {_pixels('pred')}, {shared}, " + fold.replace("WITH RECURSIVE ", "")


_MODES = f"SELECT g.* EXCLUDE (has_polygon), has_polygon AND coalesce(md, CASE WHEN a.frame IS NOT NULL THEN 'mixed' ELSE 'boxes' END) <> 'boxes' AS has_polygon FROM ({V.SHAPES}) g LEFT JOIN (SELECT run_id, frame, cls, CASE WHEN bool_or(has_polygon) THEN 'shapes' ELSE 'boxes' END AS md FROM ({V.SHAPE_PREDICTIONS}) GROUP BY ALL) m USING (run_id, frame, cls) LEFT JOIN (SELECT DISTINCT run_id, frame FROM ({V.SHAPE_PREDICTIONS})) a USING (run_id, frame)"


@query(_shapes_sql(_MODES, V.SHAPE_PREDICTIONS, _BAR) + " SELECT run_id, cls, frame, det_ord, score, tp FROM m")
def shape_matches(spark, d):
    return P.greedy_shapes(V.both_shapes(spark, d), M.shape_bar(), projected=True, outline=V.outline())


@query(_shapes_sql(_MODES, V.SHAPE_PREDICTIONS, _BAR) + f", {_AP}, h AS (SELECT run_id, cls, count(*) FILTER (tp) AS tp FROM m GROUP BY ALL) SELECT run_id, cls, n_gt, coalesce(tp, 0) AS tp, round(ap, 6) AS ap FROM n LEFT JOIN h USING (run_id, cls) JOIN ap USING (run_id, cls)")
def shape_average_precision(spark, d):
    return E.class_report_of(P.greedy_shapes(V.both_shapes(spark, d), M.shape_bar(), projected=True, count_truth=True, outline=V.outline())).select("run_id", "cls", "n_gt", "tp", *six("ap"))


_SHAPES_COMPARED = _shapes_sql(V.SHAPE_PREDICTIONS, V.SHAPES.replace("pk % 3 <> 0 AS has_polygon", "pk % 3 <> 0 AS has_polygon, 0.0 AS score"), "0") + """,
ex AS (SELECT run_id, frame, count(*) AS ne FROM pred GROUP BY ALL), ac AS (SELECT run_id, frame, count(*) AS na FROM gt GROUP BY ALL), hits AS (SELECT run_id, frame, count(*) FILTER (tp) AS nm, sum(v) AS s FROM m GROUP BY ALL)
SELECT run_id, frame, ne AS n_expected, na AS n_actual, nm AS matched, round(s / ne, 6) AS mean_iou, s / ne >= 0.95 AS passed FROM ex JOIN ac USING (run_id, frame) JOIN hits USING (run_id, frame)"""


@query(_SHAPES_COMPARED)
def shape_output_comparison(spark, d):
    return M.compare_shapes(V.both_shapes(spark, d), outline=V.outline()).select("run_id", "frame", "n_expected", "n_actual", "matched", *six("mean_iou"), "passed")


_LINES = "cut AS (SELECT run_id, frame, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 960) AS x2, least(y2, 540) AS y2 FROM gt), li AS (SELECT run_id, frame, unnest(range(y1, y2)) AS y, x1, x2 FROM cut WHERE x1 < x2 AND y1 < y2), fr AS (SELECT *, coalesce(max(x2) OVER (PARTITION BY run_id, frame, y ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS far FROM li)"


@query(f"WITH {_LINES} SELECT run_id, frame, CAST(sum(greatest(x2 - greatest(x1, far), 0)) AS BIGINT) AS pixels FROM fr GROUP BY ALL", "gt")
def covered_pixels(spark, d):
    return M.union_area(V.gt(spark, d), ("run_id", "frame"))


@query()
def box_smoothness(spark, d):
    return E.smoothness(V.gt(spark, d)).select("run_id", *six("score"))


# timed actions and fields


@query()
def action_scores(spark, d):
    a = V.actions(spark, d)
    return A.action_score(a.where("is_gt"), a.where("not is_gt")).select("challenge_id", *six("score"))


_ACTS = ", ".join(f"'{a}'" for a in A.ACTIONS)
_MAP = f"""WITH RECURSIVE ae AS ({V.ACTIONS}), g AS (SELECT challenge_id, action, frame, row_number() OVER (PARTITION BY challenge_id, action ORDER BY frame) AS k FROM (SELECT DISTINCT challenge_id, action, frame FROM ae WHERE is_gt AND action IN ({_ACTS}))),
p AS (SELECT challenge_id, action, frame, max_by(confidence, ord) AS confidence FROM ae WHERE NOT is_gt AND action IN ({_ACTS}) GROUP BY ALL),
c AS (SELECT g.challenge_id, g.action, g.k, list(p.frame ORDER BY p.confidence DESC, p.frame) AS c FROM g JOIN p ON p.challenge_id = g.challenge_id AND p.action = g.action AND abs(p.frame - g.frame) <= 12 GROUP BY ALL),
st AS (SELECT challenge_id, action, 0::BIGINT AS k, []::BIGINT[] AS used FROM (SELECT DISTINCT challenge_id, action FROM g)
 UNION ALL SELECT challenge_id, action, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END FROM (SELECT s.challenge_id, s.action, g.k, s.used, list_filter(c.c, lambda x: NOT list_contains(s.used, x))[1] AS best FROM st s JOIN g ON g.challenge_id = s.challenge_id AND g.action = s.action AND g.k = s.k + 1 LEFT JOIN c ON c.challenge_id = g.challenge_id AND c.action = g.action AND c.k = g.k)),
u AS (SELECT challenge_id, action, max_by(used, k) AS used, max(k) AS n FROM st GROUP BY ALL),
m AS (SELECT u.challenge_id, u.action, n, p.confidence, list_contains(used, p.frame) AS hit FROM u LEFT JOIN p USING (challenge_id, action)),
t AS (SELECT unnest(range(200)) / 199.0::DOUBLE AS t),
x AS (SELECT challenge_id, action, t, count(*) FILTER (hit AND confidence >= t) / max(n) AS r, coalesce(count(*) FILTER (hit AND confidence >= t) / nullif(count(*) FILTER (confidence >= t), 0), 0) AS pr FROM m, t GROUP BY ALL),
y AS (SELECT challenge_id, action, l, coalesce(max(pr) FILTER (r >= l / 10.0::DOUBLE), 0) AS p FROM x, (SELECT unnest(range(11)) AS l) GROUP BY ALL)
SELECT challenge_id, round(sum(p) / 11 / {len(A.ACTIONS)}, 6) AS map_at_1s FROM y GROUP BY 1"""


@query(_MAP)
def action_map_at_1s(spark, d):
    a = V.actions(spark, d)
    return A.mean_map_at_1s(A.map_at_1s(a.where("is_gt"), a.where("not is_gt"))).select("challenge_id", *six("map_at_1s"))


@query("SELECT g.challenge_id, g.action, g.ord AS gt_ord, p.ord AS pred_ord, g.frame AS gt_frame, p.frame AS pred_frame, round(p.confidence, 6) AS confidence FROM ae g JOIN ae p ON g.challenge_id = p.challenge_id AND g.action = p.action WHERE g.is_gt AND NOT p.is_gt AND abs(g.frame - p.frame) <= 100", "ae")
def events_within_band(spark, d):
    a = V.actions(spark, d)
    return A.band_join(a.where("is_gt"), a.where("not is_gt"), 100).select("challenge_id", "action", "gt_ord", "pred_ord", "gt_frame", "pred_frame", *six("confidence"))


@query("SELECT challenge_id, action, count(*) AS n FROM ae WHERE is_gt GROUP BY ALL HAVING count(*) >= 2", "ae")
def sufficient_truth(spark, d):
    return A.sufficient_actions(V.actions(spark, d).where("is_gt"), least=2)


_NUM = "CASE WHEN abs({p} - {a}) >= {t} OR abs(abs({p} - {a}) - {t}) <= 1e-12 THEN 0 ELSE 1 - abs({p} - {a}) / {t} END"


@query(f"SELECT pair_id, round({_NUM.format(p='kph_pred', a='kph_gt', t='3.0')}, 6) AS s_kph, round({_NUM.format(p='bounce_x_pred', a='bounce_x_gt', t='0.25')}, 6) AS s_bounce_x, round(0.04 * ({_NUM.format(p='kph_pred', a='kph_gt', t='3.0')}) + 0.23 * ({_NUM.format(p='bounce_x_pred', a='bounce_x_gt', t='0.25')}), 6) AS score FROM fields", "fields")
def cricket_scores(spark, d):
    return A.cricket_score(V.fields(spark, d)).select("pair_id", *six("s_kph", "s_bounce_x", "score"))


@query("SELECT pair_id, round(CASE WHEN abs(card_grade_pred - card_grade_gt) >= 2 THEN 0 ELSE 1 - abs(card_grade_pred - card_grade_gt) / 2.0 END * 0.15, 6) AS score FROM fields", "fields")
def card_scores(spark, d):
    return A.card_score(V.fields(spark, d)).select("pair_id", *six("score"))


@query("SELECT pair_id, CASE WHEN floor(card_grade_gt + 0.5) BETWEEN 1 AND 10 THEN CAST(floor(card_grade_gt + 0.5) AS BIGINT) END AS grade FROM fields", "fields")
def floored_grades(spark, d):
    return V.fields(spark, d).select("pair_id", X.floor_grade(F.col("card_grade_gt") + 0.5).alias("grade"))


# sets


@query("SELECT miner_hotkey, count(*) AS n FROM (SELECT DISTINCT miner_hotkey, block // 7200 AS day FROM shards WHERE validator_hotkey = 'val0' INTERSECT SELECT DISTINCT miner_hotkey, block // 7200 FROM shards WHERE validator_hotkey = 'val1') GROUP BY 1", "shards")
def common_days(spark, d):
    s = V.shards(spark, d).select("validator_hotkey", "miner_hotkey", F.floor(F.col("block") / 7200).alias("day"))
    side = lambda v: s.where(F.col("validator_hotkey") == v).select("miner_hotkey", "day")
    return side("val0").intersect(side("val1")).groupBy("miner_hotkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT hotkey, element_id FROM commits WHERE role = 'miner' EXCEPT SELECT DISTINCT hotkey, element_id FROM commits WHERE model = 'model1'", "commits")
def removed_elements(spark, d):
    c = V.commits(spark, d)
    return c.where("role = 'miner'").select("hotkey", "element_id").subtract(c.where("model = 'model1'").select("hotkey", "element_id"))


@query("SELECT element_id, count(*) AS n, max(avg_score) AS best FROM (SELECT element_id, miner_hotkey, round(avg(score), 6) AS avg_score FROM shards GROUP BY ALL) GROUP BY 1", "shards")
def element_summary(spark, d):
    m = V.shards(spark, d).groupBy("element_id", "miner_hotkey").agg(F.avg("score").alias("avg_score")).select("element_id", *six("avg_score"))
    return m.groupBy("element_id").agg(F.count("*").alias("n"), F.max("avg_score").alias("best"))


@query("SELECT challenge_id, action, frame, lag(frame) OVER w AS before, CAST(floor((lag(frame) OVER w + frame) / 2) AS BIGINT) AS from_frame, CAST(floor((lead(frame) OVER w + frame) / 2) AS BIGINT) AS to_frame FROM (SELECT DISTINCT challenge_id, action, frame FROM ae WHERE is_gt) WINDOW w AS (PARTITION BY challenge_id, action ORDER BY frame)", "ae")
def nearest_event_spans(spark, d):
    e = A.closest_event(V.actions(spark, d).where("is_gt"))
    return e.withColumn("before", F.lag("frame").over(Window.partitionBy("challenge_id", "action").orderBy("frame"))).select("challenge_id", "action", "frame", "before", "from_frame", "to_frame")


# further scalar rules over whole tables


@query("SELECT seq, lower(trim(concat(' ', upper(element_id)))) AS label, CASE WHEN uid % 15 IN (0, 1) THEN 'white' WHEN uid = 2 THEN 'black' END AS team, CASE WHEN timed_out THEN 1.0 ELSE round(score, 6) END AS confidence, CASE WHEN score > 0 THEN challenge_id ELSE miner_hotkey END AS challenge FROM shards", "shards")
def normalized_labels(spark, d):
    s = V.shards(spark, d)
    conf = X.safe_confidence(F.when(F.col("timed_out"), F.lit("bad")).otherwise(F.col("score").cast("string")), F.lit(None))
    challenge = X.first_truthy(F.when(F.col("score") > 0, F.col("challenge_id")).otherwise(""), F.lit(0), F.col("miner_hotkey"))  # an empty text and the number zero are passed over
    return s.select("seq", X.normalize_label(F.concat(F.lit(" "), F.upper("element_id"))).alias("label"), X.normalize_team(F.col("uid")).alias("team"), F.round(conf, 6).alias("confidence"), challenge.alias("challenge"))


@query("SELECT seq, CASE WHEN uid % 4 = 0 THEN nullif(trim(concat(challenge_id, ' ')), '') WHEN uid % 4 = 1 THEN '0' WHEN uid % 4 = 2 THEN miner_hotkey END AS challenge FROM shards", "shards")
def chosen_challenges(spark, d):
    k = F.col("uid") % 4
    s = V.shards(spark, d)
    text = F.when(k == 0, F.concat("challenge_id", F.lit(" "))).when(k == 1, F.lit("0")).when(k == 2, F.lit("")).otherwise(F.lit(" "))  # a text "0" is taken, an empty one is not, a blank one is and gives null
    return s.select("seq", X.first_truthy(F.lit(0), F.lit(False), text, F.col("miner_hotkey")).alias("challenge"))


@query("SELECT ord, CASE WHEN frame < 700 THEN 'frame' WHEN confidence > 0.9 THEN 'confidence' END AS problem, round(CASE WHEN frame % 40 > 25 THEN 0 ELSE 1 - frame % 40 / 25.0 * 0.5 END, 6) AS decay FROM (SELECT ord, frame, CASE WHEN confidence > 0.9 THEN confidence + 1 ELSE confidence END AS confidence FROM ae)", "ae")
def checked_actions(spark, d):
    a = V.actions(spark, d).withColumn("confidence", F.when(F.col("confidence") > 0.9, F.col("confidence") + 1).otherwise(F.col("confidence")))
    return a.select("ord", X.action_problem(F.when(F.col("frame") < 700, -1).otherwise(F.col("frame")), F.col("confidence")).alias("problem"), X.time_decay((F.col("frame") % 40).cast("double"), F.lit(25.0), F.lit(0.5)).alias("decay")).select("ord", "problem", *six("decay"))


@query("SELECT seq, sha256(CAST(to_json({'block': block, 'challenge_id': challenge_id, 'miner_hotkey': miner_hotkey}) AS VARCHAR)) AS hash FROM shards", "shards")
def record_hashes(spark, d):
    return V.shards(spark, d).select("seq", X.record_hash("miner_hotkey", "block", "challenge_id").alias("hash"))


PALETTE = {"white": (255, 255, 255), "black": (0, 0, 0), "blue": (255, 0, 0), "red": (0, 0, 255), "yellow": (0, 255, 255), "green": (0, 255, 0), "other": (128, 128, 128)}  # fixed values: blue, green, red


@query("WITH p AS (SELECT unnest(['white','black','blue','red','yellow','green','other']) AS n, unnest([255,0,255,0,0,0,128]) AS b, unnest([255,0,0,0,255,255,128]) AS g, unnest([255,0,0,255,255,0,128]) AS r, unnest(range(7)) AS i) SELECT l.run_id, l.frame, l.det_ord, arg_min(p.n, power(l.x1 % 256 - p.b, 2) * 10 + power(l.y1 % 256 - p.g, 2) * 10 + power(l.x2 % 256 - p.r, 2) * 10 + p.i) AS colour FROM gt l, p GROUP BY ALL", "gt")
def nearest_colours(spark, d):
    return V.gt(spark, d).select("run_id", "frame", "det_ord", X.nearest_colour(F.col("x1") % 256, F.col("y1") % 256, F.col("x2") % 256, PALETTE).alias("colour"))


_CORNERS = [("x1 % 3", "y1 % 3"), ("x2 % 3", "y1 % 3"), ("det_ord % 3", "y2 % 3"), ("x1 % 2", "(x2 + y2) % 3")]  # a small grid: many corners lie on edges


def _crossing(a, b, c, d) -> str:
    left = lambda p, q, r: f"(({r[1]} - {p[1]}) * ({q[0]} - {p[0]}) > ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    return f"({left(a, c, d)} <> {left(b, c, d)} AND {left(a, b, c)} <> {left(a, b, d)})"


_P = [(f"({x})", f"({y})") for x, y in _CORNERS]


@query(f"SELECT run_id, frame, det_ord, {_crossing(*_P)} OR {_crossing(_P[1], _P[2], _P[3], _P[0])} AS bowtie FROM gt", "gt")
def bowties(spark, d):
    return V.gt(spark, d).select("run_id", "frame", "det_ord", X.is_bowtie(*[F.expr(c) for p in _CORNERS for c in p]).alias("bowtie"))


@query("SELECT run_id, count(*) AS n_frames, count(*) FILTER (n >= 3) >= 4 AS enough, count(*) >= 5 AND count(*) <= 400 AS passed FROM (SELECT run_id, frame, count(*) AS n FROM pred GROUP BY ALL) GROUP BY run_id", "pred")
def gated_runs(spark, d):
    f = V.pred(spark, d).groupBy("run_id", "frame").agg(F.count("*").alias("n"))
    return f.groupBy("run_id").agg(F.count("*").alias("n_frames"), (F.count_if(F.col("n") >= 3) >= 4).alias("enough")).withColumn("passed", X.run_gate(F.lit(True), F.col("n_frames"), 5, F.lit(400)))


_FILES = "SELECT model, revision, concat(hotkey, CASE WHEN block % 5 = 0 THEN '.pt' WHEN block % 3 = 0 THEN '.txt' ELSE '.onnx' END) AS path, block % 1000 * 1024 AS size FROM commits WHERE revision = 'r1' OR block % 5 <> 0"


@query(f"SELECT model, revision, round(sum(size) / 1048576.0, 6) AS total_mb, count(*) FILTER (path LIKE '%.onnx') AS n_onnx, count(*) FILTER (path LIKE '%.onnx') > 0 AND count(*) FILTER (path LIKE '%.pt') = 0 AS only_onnx FROM ({_FILES}) GROUP BY ALL", "commits")
def repository_facts(spark, d):
    files = spark.sql(_FILES.replace("FROM commits", "FROM {commits}"), commits=V.commits(spark, d))
    return C.repo_facts(files).select("model", "revision", *six("total_mb"), "n_onnx", "only_onnx")


# joins, audit and snapshots


@query("WITH m AS (SELECT run_id, frame, cls, CASE WHEN bool_or(det_ord % 2 = 0) AND bool_or(det_ord % 2 = 1) THEN 'mixed' WHEN bool_or(det_ord % 2 = 0) THEN 'polygons' ELSE 'boxes' END AS mode FROM pred GROUP BY ALL) SELECT g.run_id, g.frame, g.det_ord, coalesce(m.mode, CASE WHEN EXISTS (SELECT 1 FROM m x WHERE x.run_id = g.run_id AND x.frame = g.frame) THEN 'mixed' ELSE 'boxes' END) AS mode FROM gt g LEFT JOIN m ON g.run_id = m.run_id AND g.frame = m.frame AND g.cls = m.cls", "gt", "pred")
def projected_truth(spark, d):
    p = V.pred(spark, d).withColumn("has_polygon", F.col("det_ord") % 2 == 0)
    return M.project_truth(V.gt(spark, d), p).select("run_id", "frame", "det_ord", "mode")


_TOP = "t AS (SELECT element_id, miner_hotkey, max(commit_block) AS commit_block, row_number() OVER (PARTITION BY element_id ORDER BY avg(score) DESC, miner_hotkey) AS r FROM shards GROUP BY element_id, miner_hotkey)"


@query(f"WITH {_TOP}, u AS (SELECT element_id, miner_hotkey, commit_block, 0 AS p, 'official' AS origin FROM t WHERE r <= 3 UNION ALL SELECT element_id, miner_hotkey, NULL, 1, 'watchlist' FROM t WHERE r BETWEEN 3 AND 6 UNION ALL SELECT element_id, miner_hotkey, commit_block, 2, 'winner' FROM t WHERE r = 1), f AS (SELECT *, row_number() OVER (PARTITION BY element_id, miner_hotkey ORDER BY p) AS k FROM u) SELECT f.element_id, f.miner_hotkey, f.commit_block, f.origin FROM f JOIN manifest USING (element_id) WHERE k = 1 AND track = 'public'", "shards", "manifest")
def audit_targets(spark, d):
    w = Window.partitionBy("element_id").orderBy(F.desc("a"), "miner_hotkey")
    t = V.shards(spark, d).groupBy("element_id", "miner_hotkey").agg(F.max("commit_block").alias("commit_block"), F.avg("score").alias("a")).withColumn("r", F.row_number().over(w))
    watch = t.where("r between 3 and 6").withColumn("commit_block", F.lit(None).cast("bigint"))
    return D.targets_from_winners(t.where("r <= 3"), watch, t.where("r = 1"), V.manifest(spark, d).where("track = 'public'"))


@query("WITH n AS (SELECT hotkey, max_by(model, block) AS rm, max_by(revision, block) AS rr FROM commits WHERE role = 'miner' AND hotkey <> 'hk005' GROUP BY 1) SELECT c.hotkey, c.block, CASE WHEN rm IS NULL THEN 'not_in_registry' WHEN rm <> c.model THEN 'model_changed' WHEN rr <> c.revision THEN 'revision_changed' END AS reason FROM commits c LEFT JOIN n USING (hotkey)", "commits")
def spotcheck_reasons(spark, d):
    c = V.commits(spark, d)
    now = c.where("role = 'miner' and hotkey <> 'hk005'").groupBy("hotkey").agg(F.max_by("model", "block").alias("model"), F.max_by("revision", "block").alias("revision"))
    return D.spotcheck_eligibility(c, now).select("hotkey", "block", "reason")


@query("SELECT seq FROM shards WHERE lane = 'public' AND miner_hotkey IN (SELECT miner_hotkey FROM shards WHERE score > 0.95) ORDER BY block, seq LIMIT 20", "shards")
def oldest_pending_checks(spark, d):
    s = V.shards(spark, d).select(F.col("miner_hotkey").alias("hotkey"), F.col("lane").alias("scoring_version"), F.col("block").alias("created"), F.col("seq").alias("check_id"), "score")
    return D.pending_checks(s, s.where("score > 0.95"), "public", 20).select(F.col("check_id").alias("seq"))


@query("WITH a AS (SELECT challenge_id, count(*) FILTER (NOT is_gt) AS n_response, count(*) FILTER (is_gt) AS n_truth FROM ae GROUP BY 1) SELECT *, n_response > 0 AND n_truth > 0 AS complete, (SELECT bool_and(n_response > 0 AND n_truth > 0) FROM a) AS exportable FROM a", "ae")
def paired_audit(spark, d):
    a = V.actions(spark, d)
    return D.audit_pairing(a.where("not is_gt"), a.where("is_gt"))


@query("WITH o AS (SELECT miner_hotkey AS hotkey, element_id, commit_block, min(block) AS first_seen, max(block) AS last_seen FROM shards WHERE 2 * block < (SELECT min(block) + max(block) FROM shards) GROUP BY ALL), n AS (SELECT miner_hotkey AS hotkey, element_id, commit_block, max(block) AS ns, CASE WHEN avg(latency_ms) < 100 THEN 'PASS' ELSE 'FAIL_RUNTIME' END AS nt FROM shards WHERE 2 * block >= (SELECT min(block) + max(block) FROM shards) GROUP BY ALL), b AS (SELECT *, first_seen IS NULL AS fresh FROM o FULL JOIN n USING (hotkey, element_id, commit_block)) SELECT hotkey, element_id, commit_block, coalesce(first_seen, ns) AS first_seen, coalesce(ns, last_seen) AS last_seen, coalesce(nt, 'FAIL_LATENCY') AS status FROM b WHERE nt IS NULL OR nt <> 'PASS'", "shards")
def merged_failures(spark, d):
    s = V.shards(spark, d).withColumnRenamed("miner_hotkey", "hotkey")
    middle = s.agg((F.min("block") + F.max("block")).alias("middle"))  # one row: earlier shards are the known state, later ones the news
    s = s.crossJoin(F.broadcast(middle))
    old = s.where("2 * block < middle").groupBy("hotkey", "element_id", "commit_block").agg(F.min("block").alias("first_seen"), F.max("block").alias("last_seen"), F.lit("FAIL_LATENCY").alias("status"))
    new = s.where("2 * block >= middle").groupBy("hotkey", "element_id", "commit_block").agg(F.max("block").alias("seen"), F.when(F.avg("latency_ms") < 100, "PASS").otherwise("FAIL_RUNTIME").alias("status"))
    return D.merge_failed_tuples(old, new)


@query("WITH r AS (SELECT miner_hotkey AS hotkey, element_id, commit_block, seq, CASE WHEN timed_out THEN 'latency' WHEN seq % 5 = 0 THEN 'drift' ELSE 'ok' END AS o FROM shards), x AS (SELECT *, sum(CASE WHEN o = 'drift' THEN 1 ELSE 0 END) OVER w AS dr FROM r WINDOW w AS (PARTITION BY hotkey, element_id, commit_block ORDER BY seq ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, CASE WHEN o = 'drift' AND dr > 2 THEN 'output' ELSE o END AS q FROM x), z AS (SELECT *, sum(CASE WHEN q <> 'output' THEN 1 ELSE 0 END) OVER (PARTITION BY hotkey, element_id, commit_block ORDER BY seq ROWS UNBOUNDED PRECEDING) AS a FROM y), u AS (SELECT * FROM z WHERE a < 5 OR (a = 5 AND q <> 'output')) SELECT hotkey, element_id, commit_block, CASE WHEN count(*) FILTER (q = 'output') > 0 THEN 'FAIL_OUTPUT' WHEN count(*) FILTER (q = 'latency') >= 3 THEN 'FAIL_LATENCY' WHEN count(*) FILTER (q = 'latency') > 0 THEN 'PENDING_LATENCY' ELSE 'PASS' END AS status, count(*) AS n_used FROM u GROUP BY ALL", "shards")
def target_statuses(spark, d):
    s = V.shards(spark, d).withColumnsRenamed({"miner_hotkey": "hotkey", "seq": "ord"})
    return D.target_status(s.withColumn("outcome", F.when(F.col("timed_out"), "latency").when(F.col("ord") % 5 == 0, "drift").otherwise("ok")))


@query("WITH m AS (SELECT element_id, uid, miner_hotkey, count(*) AS n, avg(score) AS a FROM shards GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY a DESC, n DESC, uid) AS k FROM m WHERE a > 1e-12) SELECT element_id, max(uid) FILTER (k = 1) AS winner_uid, string_agg(uid, ',' ORDER BY k) FILTER (k <= 3) AS official, string_agg(uid, ',' ORDER BY k) FILTER (k BETWEEN 4 AND 6) AS watchlist FROM r GROUP BY 1", "shards")
def winners_snapshot(spark, d):
    means = G.mean_by_miner(V.shards(spark, d))
    top = H.top_rows(means, 6)
    s = H.snapshot(top.where("rank <= 3"), top.where("rank > 3"), top.where("rank = 1"))
    names = lambda c: F.array_join(F.transform(c, lambda r: r["uid"].cast("string")), ",")
    return s.select("element_id", "winner_uid", names(F.col("official")).alias("official"), names(F.col("watchlist")).alias("watchlist"))


@query("SELECT element_id, miner_hotkey, n FROM (SELECT element_id, miner_hotkey, max(commit_block) AS commit_block, count(*) AS n, avg(score) AS a FROM (SELECT * REPLACE (CASE WHEN uid = 4 THEN 0 ELSE score END AS score) FROM shards) GROUP BY ALL) WHERE n > 5 AND a <= 1e-12", "shards")
def inactive_list(spark, d):
    s = V.shards(spark, d).withColumn("score", F.when(F.col("uid") == 4, 0.0).otherwise(F.col("score")))
    m = s.groupBy("element_id", "miner_hotkey").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.max("commit_block").alias("commit_block"))
    return G.inactive_miners(m, 5).select("element_id", "miner_hotkey", "n")


@query("WITH m AS (SELECT element_id, uid, avg(score) AS a, avg(latency_ms) / 220 AS l FROM shards GROUP BY ALL) SELECT element_id, uid, round(CASE WHEN a > 0.3 THEN weight * 0.8 ELSE 0 END, 6) AS pay, round(weight - CASE WHEN a > 0.3 THEN weight * 0.8 ELSE 0 END, 6) AS burnt, round(0.35 * a + 0.35 * l + 0.2 * a + 0.1 * l, 6) AS trusted, round(least(greatest(1 + a / 10, 1.0), 1.03), 6) AS bonus, round(least(1.0, a / l), 6) AS filled FROM m JOIN manifest USING (element_id)", "shards", "manifest")
def economics(spark, d):
    m = V.shards(spark, d).groupBy("element_id", "uid").agg(F.avg("score").alias("a"), (F.avg("latency_ms") / 220).alias("l")).join(V.manifest(spark, d), "element_id")
    a, lat = F.col("a"), F.col("l")
    pay, burnt = H.emission_split(F.col("weight"), F.when(a > 0.3, a).otherwise(0.0), 0.8)
    return m.select("element_id", "uid", pay.alias("pay"), burnt.alias("burnt"), H.trusted_composite(a, lat, a, lat).alias("trusted"), H.discovery_multiplier(1 + a / 10).alias("bonus"), H.fill_ratio(a, lat).alias("filled")).select("element_id", "uid", *six("pay", "burnt", "trusted", "bonus", "filled"))


@query("SELECT trim(event_type) AS pillar, round(sum(value - 50) / sum(sum(value - 50)) OVER (), 6) AS weight FROM events WHERE value > 50 GROUP BY 1")
def pillar_weights(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit(" "), F.col("event_type")).alias("pillar"), (F.col("value") - 50).alias("weight"))
    return A.normalize_pillar_weights(e).select("pillar", *six("weight"))


@query("SELECT seq, block // 300 * 300 AS start, seq % 3 = 0 OR block <= block // 300 * 300 + 100 AS active FROM shards", "shards")
def window_blocks(spark, d):
    start = X.window_start_of_id(X.window_id("block", 300))
    expiry = F.when(F.col("seq") % 3 != 0, start + 100)
    return V.shards(spark, d).select("seq", start.alias("start"), X.is_window_active(F.col("block"), start, expiry).alias("active"))


@query("SELECT seq, CASE WHEN uid = 3 THEN NULL ELSE replace(element_id, '/', '_') END AS safe, CASE WHEN lane = 'private' THEN 'https://h/indexprivate.json' ELSE 'https://h/index.json' END AS index_url, CASE WHEN score > 0 THEN greatest(1, CAST(trunc(score / 1000 * 7200) AS BIGINT)) END AS blocks, 'Detect' AS category, CAST(round(CASE WHEN timed_out THEN 0.1 ELSE CAST(0.04 AS DOUBLE) + (CAST(0.175 AS DOUBLE) - CAST(0.04 AS DOUBLE)) * greatest(0, least(1, score)) END * 1e9) AS BIGINT) AS delta FROM shards", "shards")
def cleaned_ids(spark, d):
    s = V.shards(spark, d)
    return s.select("seq", X.safe_element_id(F.when(F.col("uid") == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("element_id")))).alias("safe"), X.lane_index(F.lit("https://h/index.json"), F.col("lane")).alias("index_url"), X.days_to_blocks(F.col("score") / 1000).alias("blocks"), X.element_category("element_id", ["Pose", "Detect"]).alias("category"), X.adaptive_delta(F.when(~F.col("timed_out"), F.col("score")), 0.1).alias("delta")).withColumn("delta", F.round(F.col("delta") * 1e9).cast("bigint"))  # billionths: six digits would stand on halves


@query("SELECT seq, CASE uid % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN uid END AS kind, CASE WHEN uid % 3 = 0 THEN seq WHEN uid % 3 = 1 THEN block END AS frame FROM shards", "shards")
def challenge_kinds(spark, d):
    s, k = V.shards(spark, d), F.col("uid") % 4
    raw = F.when(k == 0, F.lit(" Soccer")).when(k == 1, F.lit("cricket")).when(k == 2, F.col("uid").cast("string")).otherwise(F.lit("chess"))
    third = F.col("uid") % 3
    first, second = F.when(third == 0, F.col("seq").cast("string")).otherwise("f1"), F.when(third == 1, F.col("block"))
    return s.select("seq", X.challenge_type_id(raw, {"soccer": 1, "cricket": 2}).alias("kind"), X.frame_id(first, second).alias("frame"))


@query("WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('https://store.local/challenge-objects/', page_id, '.png?sig=1') WHEN 1 THEN concat('https://sub.media.example/', page_id, '.mp4') ELSE url END AS url FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('https://cdn.example/challenge-objects/', page_id, '.png') ELSE url END AS public_url, page_id % 3 = 1 AS allowed FROM u")
def asset_urls(spark, d):
    p, k = spark.read.parquet(f"{d}/pages.parquet"), F.col("page_id") % 3
    name = F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://store.local/challenge-objects/"), name, F.lit(".png?sig=1"))).when(k == 1, F.concat(F.lit("https://sub.media.example/"), name, F.lit(".mp4"))).otherwise(F.col("url"))
    p = p.select("page_id", url.alias("url"))
    return p.select("page_id", X.public_asset_url(F.col("url"), ["store.local"], "https://cdn.example").alias("public_url"), X.url_allowed(F.col("url"), ["media.example"]).alias("allowed"))


@query("SELECT pair_id, round(coalesce(kph_pred, kph_gt), 6) AS speed, round(bounce_x_gt, 6) AS bounce FROM fields", "fields")
def aliased_fields(spark, d):
    f = V.fields(spark, d).withColumnsRenamed({"kph_pred": "kph", "kph_gt": "speed_kph", "bounce_x_gt": "rel_x"})
    return f.select("pair_id", X.alias(["kph", "speed_kph", "speed"], f.columns).alias("speed"), X.alias(["bounce_x", "rel_x"], f.columns).alias("bounce")).select("pair_id", *six("speed", "bounce"))


@query("SELECT DISTINCT object_key AS key FROM keys WHERE seq % 3 <> 1", "keys")
def index_additions(spark, d):
    k = V.keys(spark, d).withColumnRenamed("object_key", "key")
    return D.index_add(k.where("seq % 3 = 0"), k.where("seq % 3 = 2 or seq % 6 = 0"))


@query("SELECT element_id, miner_hotkey AS hotkey, concat(block, '-', challenge_id, '-', seq) AS name, CASE WHEN uid <> 4 THEN round(score, 6) END AS central, NOT timed_out AS passed FROM shards", "shards")
def spot_check_rows(spark, d):
    s = V.shards(spark, d).select("element_id", F.col("miner_hotkey").alias("hotkey"), "block", "challenge_id", F.col("seq").alias("ts"), F.when(F.col("uid") == 4, F.lit(float("nan"))).otherwise(F.col("score")).alias("central_score"), F.lit(float("inf")).alias("audit_score"), (~F.col("timed_out")).alias("passed"))
    r = S.audit_rows(s)
    return r.select("element_id", "hotkey", "name", F.round(F.get_json_object("result", "$.central_score").cast("double"), 6).alias("central"), F.get_json_object("result", "$.passed").cast("boolean").alias("passed"))


@query("WITH m AS (SELECT element_id, max_by(miner_hotkey, block * 1000000 + seq) AS winner_hotkey FROM shards GROUP BY 1) SELECT m.element_id, winner_hotkey, max(commit_block) FILTER (miner_hotkey = winner_hotkey AND uid % 2 = 0 OR miner_hotkey = winner_hotkey AND uid % 3 = 0) AS commit_block FROM m JOIN shards s USING (element_id) GROUP BY ALL", "shards")
def winner_targets(spark, d):
    row = F.struct(F.col("miner_hotkey").alias("hotkey"), F.col("commit_block").cast("bigint").alias("commit_block"))
    s = V.shards(spark, d).groupBy("element_id").agg(F.max_by("miner_hotkey", F.struct("block", "seq")).alias("winner_hotkey"), F.collect_set(F.when(F.col("uid") % 2 == 0, row)).alias("official"), F.collect_set(F.when(F.col("uid") % 3 == 0, row)).alias("ranks"))
    return D.winner_target(s)


@query("SELECT uid, round(avg(score), 6) AS avg_score, 'some' AS source FROM shards GROUP BY 1 UNION ALL SELECT 99, 0.0, 'none'", "shards")
def fallback_means(spark, d):
    m = V.shards(spark, d).groupBy("uid").agg(F.avg("score").alias("avg_score"))
    some, none = G.with_fallback(m, 99).withColumn("source", F.lit("some")), G.with_fallback(m.where("uid < 0"), 99).withColumn("source", F.lit("none"))
    return some.union(none).select("uid", *six("avg_score"), "source")


@query(_COMPARED + " SELECT run_id, frame, nm > 0 AND ne - nm <= 2 AND na - nm <= 2 AND mean >= 0.95 AS soft FROM fr")
def soft_drifts(spark, d):
    c = M.compare_outputs(V.gt(spark, d), V.pred(spark, d))
    return c.select("run_id", "frame", M.soft_drift(F.col("matched"), F.col("n_expected") - F.col("matched"), F.col("n_actual") - F.col("matched"), F.col("mean_iou")).alias("soft"))


@query("SELECT hotkey, element_id, max(block) AS block, max_by(model, block) AS model FROM commits WHERE block % 3 = 0 AND (role = 'miner' OR block % 4 = 0) GROUP BY 1, 2", "commits")
def private_commits(spark, d):
    c = V.commits(spark, d).withColumns({"track": F.when(F.col("block") % 3 == 0, "private").otherwise("public"), "role": F.when(F.col("block") % 4 != 0, F.col("role"))})
    return C.latest_private_commit(c).select("hotkey", "element_id", "block", "model")


@query("WITH h AS (SELECT element_id, miner_hotkey, challenge_id, max_by(score, block * 1000000 + seq) AS score FROM shards GROUP BY ALL), b AS (SELECT a.element_id, a.challenge_id, a.score AS winner_score, c.score AS candidate_score, row_number() OVER (PARTITION BY a.element_id ORDER BY sha256(concat('w9:', a.challenge_id)), a.challenge_id) AS r FROM h a JOIN h c USING (element_id, challenge_id) WHERE a.miner_hotkey = 'hk005' AND c.miner_hotkey = 'hk010' AND challenge_id NOT IN ('c1', 'c7')) SELECT element_id, challenge_id, round(winner_score, 6) AS winner_score, round(candidate_score, 6) AS candidate_score FROM b WHERE r <= 4", "shards")
def common_histories(spark, d):
    h = G.challenge_map(V.shards(spark, d))
    of = lambda who: h.where(F.col("miner_hotkey") == who).drop("miner_hotkey")
    out = spark.createDataFrame([("c1",), ("c7",)], "challenge_id string")
    return C.common_history(of("hk005"), of("hk010"), out, "w9", 4).select("element_id", "challenge_id", *six("winner_score", "candidate_score"))


_EXPORT = """WITH r AS (SELECT pair_id, pair_id % 7 <> 0 AS has, CASE WHEN pair_id % 2 = 0 THEN 'cricket' WHEN pair_id % 5 = 0 THEN 'other' ELSE 'actions' END AS t, CAST(floor(kph_gt) AS BIGINT) AS k FROM fields),
x AS (SELECT pair_id, t AS truth_type, CASE WHEN NOT has OR t = 'other' THEN NULL WHEN t = 'cricket' THEN concat('{"bounce":"', pair_id % 30, '","kph":"', k, '"}') ELSE concat('[{"frame":', pair_id % 30, ',"action":"pass"}]') END AS response,
  CASE WHEN t = 'other' THEN NULL WHEN t = 'cricket' THEN concat('{"kph":"', k, '"}') ELSE concat('[{"frame":', k, ',"action":"shot"}]') END AS truth FROM r)
SELECT *, response IS NOT NULL AND truth IS NOT NULL AS complete, false AS exportable FROM x"""


@query(_EXPORT, "fields")
def audit_exports(spark, d):
    k, has = F.floor("kph_gt").cast("string"), F.col("pair_id") % 7 != 0
    spot = (F.col("pair_id") % 30).cast("string")
    kind = F.when(F.col("pair_id") % 2 == 0, "cricket").when(F.col("pair_id") % 5 == 0, "other").otherwise("actions")
    fields = F.when(has, F.concat(F.lit('{"note":"x","kph":'), k, F.lit(',"bounce":'), spot, F.lit(',"swing":null}'))).otherwise('{"note":"x"}')
    listed = F.when(has, F.concat(F.lit('[{"frame":'), spot, F.lit(',"action":"pass"},{"frame":3}]'))).otherwise("no json")
    own = F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit('{"kph":'), k, F.lit("}"))).otherwise(F.concat(F.lit('[{"action":"shot","frame":'), k, F.lit("}]")))
    rows = V.fields(spark, d).select("pair_id", kind.alias("truth_type"), F.when(F.col("pair_id") % 2 == 0, fields).otherwise(listed).alias("response"), own.alias("truth"))
    return D.audit_export(rows, {"kph": 1.0, "bounce": 0.5, "swing": 1.0, "note": 0.0}, "pair_id")


_PANES = "p AS (SELECT CAST(floor((1704067200 + block * 12) / 43200) AS BIGINT) * 43200 AS pane, element_id, miner_hotkey, count(*) AS n, sum(score) AS s FROM shards GROUP BY ALL)"


@query(f"WITH {_PANES}, w AS (SELECT pane - 43200 * k AS start, * FROM p, (SELECT unnest(range(4)) AS k)) SELECT start, element_id, miner_hotkey, CAST(sum(n) AS BIGINT) AS n, round(sum(s), 6) AS total FROM w GROUP BY ALL", "shards")
def sliding_means(spark, d):
    s = T.with_time(V.shards(spark, d))
    return T.sliding_scores(s, 14400, 3600).select(F.unix_seconds("start").alias("start"), "element_id", "miner_hotkey", "n", F.round(F.col("avg_score") * F.col("n"), 6).alias("total"))


@query(f"WITH {_PANES} SELECT pane AS start, element_id, miner_hotkey, n, round(s, 6) AS total FROM p", "shards")
def tumbling_means(spark, d):
    s = T.with_time(V.shards(spark, d))
    return T.tumbling_scores(s, 3600).select(F.unix_seconds("start").alias("start"), "element_id", "miner_hotkey", "n", F.round(F.col("avg_score") * F.col("n"), 6).alias("total"))


# sources, from JSON that Spark derives from the tables


@query("SELECT run_id, frame, cls AS label, count(*) AS n, round(sum(score), 6) AS score, sum(x1) AS x1, sum(y2) AS y2 FROM pred GROUP BY ALL", "pred")
def flattened_predictions(spark, d):
    objects = ["A", "N", "R"]
    cls = F.array_position(F.array(*[F.lit(o) for o in objects]), F.col("cls")).cast("int") - 1
    p = V.pred(spark, d).withColumn("b", F.struct("x1", "y1", "x2", "y2", cls.alias("cls_id"), F.col("score").alias("conf")))
    frames = p.groupBy("run_id", "frame").agg(F.collect_list("b").alias("boxes")).select("run_id", F.to_json(F.array(F.struct(F.col("frame").alias("frame_id"), "boxes"))).alias("frames"))
    out = S.flatten_predictions(frames, objects)
    return out.groupBy("run_id", "frame", "label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.sum("x1").alias("x1"), F.sum("y2").alias("y2"))


@query("SELECT run_id AS challenge_id, frame, count(*) AS n, sum(x2 - x1) AS wide FROM gt GROUP BY ALL", "gt")
def flattened_truth(spark, d):
    a = F.struct(F.col("frame").cast("string").alias("frame_idx"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("cls").alias("label"))
    t = V.gt(spark, d).groupBy(F.col("run_id").alias("challenge_id"), "frame").agg(F.to_json(F.struct(F.collect_list(a).alias("annotations"))).alias("truth"))
    out = S.flatten_ground_truth(t)
    return out.select("challenge_id", "frame", F.size("boxes").cast("bigint").alias("n"), F.aggregate("boxes", F.lit(0).cast("bigint"), lambda s, b: s + b["x2"] - b["x1"]).alias("wide"))


@query("SELECT hotkey, block, role, element_id, model, revision FROM commits WHERE block % 7 <> 0", "commits")
def decoded_commitments(spark, d):
    payload = F.when(F.col("block") % 7 == 0, "{broken").otherwise(F.to_json(F.struct("role", "element_id", "model", "revision")))
    return S.read_commitments(V.commits(spark, d).select("hotkey", "block", payload.alias("payload"))).select("hotkey", "block", "role", "element_id", "model", "revision")


@query("SELECT lane, element_id, block, score, latency_ms AS p95, true AS latency_pass, concat('https://host/', object_key) AS url FROM keys", "keys")
def shard_rows(spark, d):
    k = V.keys(spark, d).withColumns({"window_id": X.window_id("block", 300)})
    out = S.shard_payload(k, "object_key")
    return out.select("lane", "element_id", F.col("payload.block").alias("block"), F.col("payload.score").alias("score"), F.col("payload.p95_latency_ms").alias("p95"), F.col("payload.latency_pass").alias("latency_pass"), X.resolve_key(F.lit("https://host/x/index.json"), F.col("object_key"), "results").alias("url"))


@query("SELECT element_id, miner_hotkey, CASE WHEN lane = 'private' THEN challenge_id END AS challenge_id, count(*) AS n FROM shards WHERE NOT timed_out GROUP BY ALL", "shards")
def published_rows(spark, d):
    s = V.shards(spark, d).where(X.is_weight_eligible(F.col("timed_out")))
    return S.public_projection(s, ["element_id", "miner_hotkey"], ["challenge_id"], F.col("lane") == "private").groupBy("element_id", "miner_hotkey", "challenge_id").agg(F.count("*").alias("n"))


@query("SELECT miner_hotkey AS hotkey, element_id, commit_block FROM shards WHERE score = 0 OR timed_out GROUP BY ALL", "shards")
def inactive_union(spark, d):
    s = V.shards(spark, d).withColumnRenamed("miner_hotkey", "hotkey")
    return S.upsert_inactive(s.where("score = 0"), s.where("timed_out"))


@query("SELECT element_id, max(block) AS block, max_by(uid, block * 1000000 + seq) AS uid FROM shards GROUP BY element_id HAVING max(block) = (SELECT max(block) FROM shards)", "shards")
def newest_snapshot(spark, d):
    s = V.shards(spark, d).groupBy("element_id").agg(F.max("block").alias("block"), F.max_by("uid", F.col("block") * 1_000_000 + F.col("seq")).alias("uid"))
    return S.latest_snapshot(s.select("block", "element_id", "uid")).select("element_id", "block", "uid")


@query("SELECT concat('block-', CAST(block // 7200 * 7200 AS VARCHAR)) AS window_id, element_id, count(DISTINCT challenge_id) AS n_clips, count(DISTINCT miner_hotkey) AS n_miners, theta, beta FROM shards JOIN manifest USING (element_id) GROUP BY ALL", "shards", "manifest")
def elements_by_window(spark, d):
    return G.element_window_summary(V.shards(spark, d).withColumn("window_id", X.window_id("block", 7200)), V.manifest(spark, d))


_BOTH = f"0.04 * ({_NUM.format(p='kph_pred', a='kph_gt', t='3.0')}) + 0.23 * ({_NUM.format(p='bounce_x_pred', a='bounce_x_gt', t='0.25')})"
_CARD = "0.15 * CASE WHEN abs(card_grade_pred - card_grade_gt) >= 2 THEN 0 ELSE 1 - abs(card_grade_pred - card_grade_gt) / 2.0 END"


@query(f"SELECT pair_id AS id, round(CASE pair_id % 3 WHEN 0 THEN {_BOTH} WHEN 1 THEN {_CARD} ELSE 0 END, 6) AS score FROM fields", "fields")
def scores_by_truth_type(spark, d):
    t = X.truth_type(F.lit(None).cast("string"), F.element_at(F.array(F.lit('{"kph": 1}'), F.lit('{"card_grade": 1}'), F.lit("{}")), (F.col("pair_id") % 3).cast("int") + 1))
    rows = V.fields(spark, d).withColumnRenamed("pair_id", "id").withColumn("pair_id", F.col("id")).withColumn("truth_type", t)
    return A.dispatch(rows, {"cricket": A.cricket_score, "card": A.card_score}).select("id", *six("score"))


@query(f"WITH s AS (SELECT pair_id, {_BOTH} AS a, ({_BOTH}) * CASE WHEN pair_id % 4 = 0 THEN 0.5 ELSE 0.99 END AS c FROM fields) SELECT pair_id, round(CASE WHEN a = 0 AND c = 0 THEN 1 WHEN a = 0 OR c = 0 THEN 0 ELSE 1 - abs(a - c) / greatest(a, c) END, 6) AS match, CASE WHEN a = 0 AND c = 0 THEN true WHEN a = 0 OR c = 0 THEN false ELSE 1 - abs(a - c) / greatest(a, c) >= 0.95 END AS passed FROM s", "fields")
def rescored_fields(spark, d):
    again = A.cricket_score(V.fields(spark, d)).select("pair_id", "score")
    published = again.withColumn("score", F.col("score") * F.when(F.col("pair_id") % 4 == 0, 0.5).otherwise(0.99))
    return D.rescored(published, again, "pair_id").select("pair_id", *six("match"), "passed")
