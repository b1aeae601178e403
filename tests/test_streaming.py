"""A stream over files gives what the batch gives."""

import pytest
from pyspark.sql import functions as F

from scoregrid.operators.audit import latency_streak
from scoregrid.operators.rank import ewma
from scoregrid.plans import views
from scoregrid.streaming import ops

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    s = views.shards(spark, DATA).where("element_id = 'ns/Detect-click'").select("seq", "block", "element_id", "miner_hotkey", "validator_hotkey", "challenge_id", "score", "latency_ms")
    s.coalesce(1).write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows(spark, rows, tmp_path):
    batch, stream = rows
    got = drain(ops.tumbling_scores(ops.with_time(stream), 7200), "tumbling", "complete", tmp_path)
    want = ops.tumbling_scores(ops.with_time(batch), 7200)
    r = lambda d: sorted((x["start"], x["miner_hotkey"], x["n"], round(x["avg_score"], 9)) for x in d.collect())
    assert r(got) == r(want) and got.count() > 0
    assert ops.sliding_scores(ops.with_time(batch), 14400, 7200).agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_sliding_panes(spark, rows, tmp_path):
    """Panes in state give the windows of a batch, as far as the watermark has passed their ends; files come in event-time order."""
    batch, _ = rows
    path = str(tmp_path / "ordered")
    low, high = batch.agg(F.min("block"), F.max("block")).first()
    for k in range(5):  # one file after another, as their times tell the stream's order
        ops.with_time(batch).where(F.floor((F.col("block") - low) * 5 / (high - low + 1)) == k).coalesce(1).write.mode("append").parquet(path)
    back = spark.read.parquet(path)
    stream = spark.readStream.schema(back.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(ops.sliding_scores_stream(stream, 14400, 3600, "365 days"), "panes_late", "append", tmp_path)
    assert got.count() == 0  # nothing is final yet
    got = drain(ops.sliding_scores_stream(stream, 14400, 3600, "0 seconds"), "panes", "append", tmp_path)
    want = ops.sliding_scores(back, 14400, 3600)
    by_rows = want.groupBy().agg(F.sum("n")).first()[0]
    assert by_rows == 4 * batch.count()
    r = lambda d: {(x["start"], x["miner_hotkey"]): (x["n"], round(x["avg_score"], 9)) for x in d.collect()}
    passed = back.where(F.floor((F.col("block") - low) * 5 / (high - low + 1)) < 4).agg(F.max("ts")).first()[0]  # the watermark that the last file meets
    done, every = r(got), r(want)
    assert done and done == {k: v for k, v in every.items() if k in done}
    missing = [k for k in every if k not in done]
    assert all((passed - k[0]).total_seconds() < 14400 * 12 for k in missing)


def test_dedup_keeps_one(spark, rows, tmp_path):
    batch, stream = rows
    got = drain(ops.dedup_stream(ops.with_time(stream), "365 days"), "dedup", "append", tmp_path)
    assert got.count() == batch.select("validator_hotkey", "miner_hotkey", "element_id", "challenge_id").distinct().count()


def test_keyed_state(spark, rows, tmp_path):
    batch, stream = rows
    got = {r["miner_hotkey"]: (round(r["ewma"], 9), r["n"]) for r in drain(ops.ewma_stream(stream, 20), "ewma", "update", tmp_path).collect()}
    want = {r["miner_hotkey"]: (round(r["ewma"], 9), r["n"]) for r in ewma(batch, ("miner_hotkey",), ("block", "seq"), "score", 20).collect()}
    assert got == want
    got = {r["seq"]: (r["streak"], r["status"]) for r in drain(ops.streak_stream(stream, 100.0), "streak", "append", tmp_path).collect()}
    want = {r["seq"]: (r["streak"], r["status"]) for r in latency_streak(batch, ("miner_hotkey",), F.col("latency_ms") <= 100, ("block", "seq")).collect()}
    assert got == want


def test_upserts_keep_what_earlier_batches_saw(spark, tmp_path):
    path = str(tmp_path / "failures")
    schema = "hotkey string, element_id string, commit_block long, seen long, status string"
    write = ops.upsert_writer(path)
    batches = [[("a", "e", 1, 10, "FAIL_LATENCY"), ("b", "e", 1, 11, "FAIL_OUTPUT")], [("a", "e", 1, 20, "FAIL_RUNTIME"), ("a", "e", 1, 15, "PASS")], [("a", "e", 1, 30, "FAIL_LATENCY"), ("c", "e", 2, 31, "PASS")]]
    for k, rows in enumerate([*batches, batches[2]]):
        write(spark.createDataFrame(rows, schema), min(k, 2))
    got = {r["hotkey"]: (r["first_seen"], r["last_seen"], r["status"]) for r in ops.read_upserts(spark, path).collect()}
    assert got == {"a": (10, 30, "FAIL_LATENCY"), "b": (11, 11, "FAIL_OUTPUT")}
    write(spark.createDataFrame([("a", "e", 1, 40, "PASS")], schema), 3)
    assert {r["hotkey"] for r in ops.read_upserts(spark, path).collect()} == {"b"}


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    """A shard older than the watermark reaches neither its window nor a later one; the batch form counts it."""
    schema = "seq long, block long, element_id string, miner_hotkey string, validator_hotkey string, challenge_id string, score double, latency_ms double"
    path = str(tmp_path / "shards")
    rows = [[(1, 100, "e", "m", "v", "c1", 1.0, 1.0)], [(2, 500_000, "e", "m", "v", "c2", 1.0, 1.0)], [(3, 101, "e", "m", "v", "c3", 0.0, 1.0), (4, 1_000_000, "e", "m", "v", "c4", 1.0, 1.0)]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        scores = ops.tumbling_scores(ops.with_time(spark.readStream.schema(schema).parquet(path)), 7200)
        scores.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    batch = ops.tumbling_scores(ops.with_time(spark.read.schema(schema).parquet(path)), 7200).collect()
    first = lambda d: min(d, key=lambda r: r["start"])
    assert first(got)["n"] == 1 and first(batch)["n"] == 2


def test_warmup_of_shuffled_batches(spark, tmp_path):
    """Rows in any order of arrival give the batch's rows exactly: leading zeros of recent commits go, other lanes and commits keep all."""
    from random import Random

    from scoregrid.operators.select import warmup_trim

    rng, rows, head = Random(6), [], 8_100_000
    for k in range(24):
        lane, commit = "private" if k % 6 == 5 else "public", None if k % 8 == 7 else head - (30_000 if k % 4 == 3 else 100)
        zeros = k % 8
        rows += [("e", f"m{k}", commit, head - 1000 + 7 * i, 100 * k + i, 0.0 if i < zeros or rng.random() < 0.2 else 0.5, lane) for i in range(12)]
    schema = "element_id string, miner_hotkey string, commit_block long, block long, seq long, score double, lane string"
    table = ops.with_time(spark.createDataFrame(rows, schema))
    path = str(tmp_path / "shuffled")
    rng.shuffle(rows)
    for k in range(4):
        ops.with_time(spark.createDataFrame(rows[k::4], schema)).coalesce(1).write.mode("append").parquet(path)
    for k in (1, 2):  # later rows of another key move the watermark past all others
        ops.with_time(spark.createDataFrame([("e", "later", None, head + 10_000 * k, k, 1.0, "public")], schema)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(ops.warmup_stream(stream, head, late="6 hours"), "warmup", "append", tmp_path).where("miner_hotkey <> 'later'")
    want = warmup_trim(table.withColumn("max_block", F.lit(head)))
    r = lambda d: sorted((x["miner_hotkey"], x["block"], x["seq"], x["score"]) for x in d.collect())
    assert r(got) == r(want) and len(r(want)) < len(rows)


def test_upserts_write_deltas_and_compact(spark, tmp_path):
    """Any compaction gives the state of merging batch by batch; a rerun changes nothing, and what a base holds is removed."""
    from random import Random

    schema = "hotkey string, element_id string, commit_block long, seen long, status string"
    rng = Random(1)
    batches = [[(rng.choice("abcd"), "e", 1, 10 * k + j, rng.choice(["PASS", "FAIL_LATENCY", "FAIL_OUTPUT"])) for j in range(3)] for k in range(7)]
    states = []
    for compact in (2, 100):
        path = str(tmp_path / f"upserts{compact}")
        write = ops.upsert_writer(path, compact)
        for k, rows in enumerate(batches):
            write(spark.createDataFrame(rows, schema), k)
            write(spark.createDataFrame(rows, schema), k)
        states.append(sorted(tuple(r) for r in ops.read_upserts(spark, path).collect()))
    assert states[0] == states[1] and states[0]
    assert ops._versions(spark, str(tmp_path / "upserts2" / "base")) == [3, 5] and ops._versions(spark, str(tmp_path / "upserts2" / "delta")) == [4, 5, 6]
    assert ops._versions(spark, str(tmp_path / "upserts100" / "base")) == []
