"""Views of the test tables in the shapes of the operators' inputs; the same text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEALT = 500_000  # rows of lineitem in a task where frames are dealt, so that their sorts stay in memory

SHARDS = """SELECT event_id AS seq,
  8000000 + CAST(floor((EPOCH(ts) - 1704067200) / 12) AS BIGINT) AS block,
  concat('ns/Detect-', event_type) AS element_id,
  CASE WHEN event_type = 'signup' THEN 'private' ELSE 'public' END AS lane,
  CAST(user_id % 15 AS INT) AS uid,
  concat('hk', lpad(CAST(user_id % 15 AS VARCHAR(9)), 3, '0')) AS miner_hotkey,
  concat('val', CAST(event_id % 2 AS VARCHAR(9))) AS validator_hotkey,
  8100000 - user_id % 15 % 2 * 200000 + CAST(floor(user_id / 15) AS BIGINT) % 3 * 50000 + user_id % 15 AS commit_block,
  concat('c', CAST(event_id % 40 AS VARCHAR(9))) AS challenge_id,
  CASE WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE)
       WHEN user_id % 15 % 5 = 0 THEN (50 + event_id % 40) / CAST(100 AS DOUBLE) + user_id % 15 / CAST(10000 AS DOUBLE)
       ELSE least(value / 100, 1) END AS score,
  20 + value AS latency_ms, value > 150 AS timed_out
FROM events"""

KEYS = f"""SELECT s.*, concat('results/', replace(element_id, '/', '_'), '/', miner_hotkey, '/', lpad(CAST(commit_block AS VARCHAR(9)), 9, '0'),
  '/evaluation/', lpad(CAST(block AS VARCHAR(9)), 9, '0'), '-', challenge_id, '.json') AS object_key FROM ({SHARDS}) s"""

_U = """SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS q,
  min(l_discount) AS dc, min(l_tax) AS tx, min(l_returnflag) AS cls FROM lineitem GROUP BY l_orderkey, l_linenumber"""

GT = f"""SELECT l_orderkey % 50 AS run_id, l_orderkey AS frame, l_linenumber AS det_ord, cls,
  pk*7%800 AS x1, sk*13%400 AS y1, pk*7%800 + 20 + CAST(q AS BIGINT)*3 AS x2, sk*13%400 + 20 + l_linenumber*15 AS y2
FROM ({_U}) u WHERE pk % 9 <> 0"""

PRED = f"""SELECT l_orderkey % 50 AS run_id, l_orderkey AS frame, l_linenumber AS det_ord,
  CASE WHEN pk % 13 = 0 THEN 'A' ELSE cls END AS cls,
  pk*7%800 + pk%17 AS x1, sk*13%400 + sk%5 AS y1, pk*7%800 + pk%17 + 20 + CAST(q AS BIGINT)*3 AS x2,
  sk*13%400 + sk%5 + 20 + l_linenumber*15 AS y2, round(1 - dc*5 - tx, 6) AS score
FROM ({_U}) u WHERE pk % 7 <> 0"""

# small shapes: a box (x1, y1, x2, y2), and has_polygon where its outline below counts
_SHAPE = """l_orderkey % 50 AS run_id, l_orderkey AS frame, l_linenumber AS det_ord, cls, pk * 7 % 40 AS x1, sk * 13 % 30 AS y1,
  pk * 7 % 40 + 4 + CAST(q AS BIGINT) % 6 AS x2, sk * 13 % 30 + 4 + l_linenumber AS y2, pk % 3 <> 0 AS has_polygon"""

SHAPES = f"""SELECT {_SHAPE}
FROM ({_U}) u WHERE pk % 9 <> 0"""

_PREDICTED_SHAPE = """l_orderkey % 50 AS run_id, l_orderkey AS frame, l_linenumber AS det_ord, CASE WHEN pk % 13 = 0 THEN 'A' ELSE cls END AS cls,
  pk * 7 % 40 + pk % 2 AS x1, sk * 13 % 30 + sk % 2 AS y1, pk * 7 % 40 + pk % 2 + 4 + CAST(q AS BIGINT) % 6 AS x2, sk * 13 % 30 + sk % 2 + 4 + l_linenumber AS y2,
  (pk + sk) % 2 = 0 AS has_polygon, round(1 - dc*5 - tx, 6) AS score"""

SHAPE_PREDICTIONS = f"""SELECT {_PREDICTED_SHAPE}
FROM ({_U}) u WHERE pk % 7 <> 0"""

OUTLINE = [("x1", "y1"), ("x2", "y1 + 1"), ("x2 - 1", "y2"), ("x1 + 2", "y2 - 2"), ("x1 + 1", "y2")]

ACTIONS = """SELECT user_id AS challenge_id, event_id % 3 = 0 AS is_gt, event_id AS ord,
  CAST(floor(EPOCH(ts)) AS BIGINT) % 1500 AS frame,
  CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'shot' WHEN 'purchase' THEN 'goal'
    WHEN 'signup' THEN 'tackle' ELSE 'unknown_action' END AS action,
  least(value/200, 1) AS confidence
FROM events"""

COMMITS = """SELECT concat('hk', lpad(CAST(o_custkey % 40 AS VARCHAR(9)),3,'0')) AS hotkey, 7000000 + o_orderkey AS block,
  CASE WHEN o_orderkey % 10 = 0 THEN 'central_validator' ELSE 'miner' END AS role,
  concat('ns/Detect-', CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'error' END) AS element_id,
  concat('model', CAST(o_custkey % 12 AS VARCHAR(9))) AS model,
  concat('r', CAST(o_orderkey % 3 AS VARCHAR(9))) AS revision
FROM orders"""

FIELDS = f"""SELECT l_orderkey*10 + l_linenumber AS pair_id, 120 + q/5 AS kph_gt, 120 + q/5 + dc*20 AS kph_pred,
  pk%30/CAST(10 AS DOUBLE) AS bounce_x_gt, pk%30/CAST(10 AS DOUBLE) + tx AS bounce_x_pred,
  1 + pk%10 AS card_grade_gt, 1 + (pk + l_linenumber%3)%10 AS card_grade_pred
FROM ({_U}) u"""

MANIFEST = """SELECT * FROM (VALUES
  ('ns/Detect-click', CAST(0.3 AS DOUBLE), CAST(0.4 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(1.0 AS DOUBLE), 'public'),
  ('ns/Detect-error', CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(1.4 AS DOUBLE), 'public'),
  ('ns/Detect-purchase', CAST(0.25 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.01 AS DOUBLE), CAST(1.0 AS DOUBLE), 'public'),
  ('ns/Detect-signup', CAST(0.15 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(2.0 AS DOUBLE), 'private'),
  ('ns/Detect-view', CAST(0.2 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.02 AS DOUBLE), CAST(1.0 AS DOUBLE), 'public')
) AS m(element_id, weight, theta, delta_floor, beta, track)"""

def view(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A view's text over the tables in sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text.replace("EPOCH(ts)", "unix_timestamp(CAST(ts AS TIMESTAMP))"), **frames)


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SHARDS, "events")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, KEYS, "events")


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GT, "lineitem")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PRED, "lineitem")


def outline() -> Column:
    """The polygon of a row of SHAPES or SHAPE_PREDICTIONS, null for a box."""
    points = ", ".join(f"struct(CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y)" for x, y in OUTLINE)
    return F.expr(f"CASE WHEN has_polygon THEN array({points}) END")


def _outlined(df: DataFrame) -> DataFrame:
    return df.withColumn("polygon", outline()).drop("has_polygon")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlined(view(spark, sf_dir, SHAPES, "lineitem"))


def shape_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlined(view(spark, sf_dir, SHAPE_PREDICTIONS, "lineitem"))


def both_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of shapes() and, with the flag second, of shape_predictions(), without outlines: from one reading of lineitem, dealt once, by frame."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tasks = max(lines.count() // DEALT + 1, spark.sparkContext.defaultParallelism)
    u = spark.sql(_U.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines.repartition(tasks, "l_orderkey"))
    sides = f"inline(array(if(pk % 9 <> 0, struct({_SHAPE}, CAST(0 AS DOUBLE) AS score, false AS second), null), if(pk % 7 <> 0, struct({_PREDICTED_SHAPE}, true AS second), null)))"
    return u.selectExpr("l_orderkey", sides).where("second is not null").selectExpr("run_id", "l_orderkey AS frame", "cls", "det_ord", "score", "x1", "y1", "x2", "y2", "has_polygon", "second")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ACTIONS, "events")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, COMMITS, "orders")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FIELDS, "lineitem")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANIFEST)
