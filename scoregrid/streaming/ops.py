"""Structured Streaming: windowed scores, de-duplication and keyed state. A block is 12 seconds of event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.exprs import BLOCKS_PER_DAY
from ..operators.audit import merge_failed_tuples

SECONDS = 12


def with_time(df: DataFrame, epoch0: str = "2024-01-01 00:00:00") -> DataFrame:
    """ts of a block: epoch0 + block * 12 s."""
    return df.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(epoch0).cast("timestamp")) + F.col("block") * SECONDS))


def tumbling_scores(df: DataFrame, tempo: int, late: str = "1 hour") -> DataFrame:
    """Mean score of each window of `tempo` blocks, element and miner; append mode after the watermark."""
    w = F.window("ts", f"{tempo * SECONDS} seconds")
    return df.withWatermark("ts", late).groupBy(w, "element_id", "miner_hotkey").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")).select(F.col("window.start").alias("start"), "element_id", "miner_hotkey", "n", "avg_score")


def _pane(tempo: int) -> Column:
    """Seconds at which the pane of a row's ts begins."""
    return F.floor(F.unix_seconds("ts") / (tempo * SECONDS)) * (tempo * SECONDS)


def sliding_scores(df: DataFrame, tail: int, tempo: int) -> DataFrame:
    """(start, element_id, miner_hotkey, n, avg_score): mean over windows of `tail` blocks (a multiple of `tempo`), moved on by `tempo`, of a finished table.

    Rows are summed by pane of `tempo` blocks first; only panes are shown to their tail / tempo windows.
    """
    panes = df.groupBy(_pane(tempo).alias("pane"), "element_id", "miner_hotkey").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    back = F.sequence(F.lit(0), F.lit(tail // tempo - 1))
    shown = panes.withColumn("start", F.explode(F.transform(back, lambda k: F.timestamp_seconds(F.col("pane") - k * tempo * SECONDS))))
    return shown.groupBy("start", "element_id", "miner_hotkey").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg_score"))


class Panes(StatefulProcessor):
    """Sums by pane; the window that ends with a pane goes out once the watermark passes its end, and panes that left all windows are dropped."""

    def __init__(self, tail: int, tempo: int):
        self.tail, self.tempo = tail * SECONDS, tempo * SECONDS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane bigint", "n bigint, total double")
        self.done = handle.getValueState("done", "end bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen, total = {}, {}
        for part in rows:
            for pane, v in part[["pane", "score"]].itertuples(index=False):
                seen[int(pane)] = seen.get(int(pane), 0) + 1
                total[int(pane)] = total.get(int(pane), 0.0) + float(v)
        for pane, n in seen.items():
            old = self.panes.getValue((pane,)) if self.panes.containsKey((pane,)) else (0, 0.0)
            self.panes.updateValue((pane,), (int(old[0]) + n, float(old[1]) + total[pane]))
            self.handle.registerTimer((pane + self.tempo) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs())) // 1000
        held = {int(p[0]): (int(v[0]), float(v[1])) for p, v in self.panes.iterator()}
        done = int(self.done.get()[0]) if self.done.exists() else None
        out = []
        # several ends may be due, and only those with a pane of their own have a timer
        ends = sorted({p + k * self.tempo for p in held for k in range(1, self.tail // self.tempo + 1)})
        for end in ends:
            if end <= last and (done is None or end > done):
                inside = [held[p] for p in sorted(held) if end - self.tail <= p < end]
                n = sum(x[0] for x in inside)
                out.append((pd.Timestamp(end - self.tail, unit="s"), key[0], key[1], n, sum(x[1] for x in inside) / n))
        if done is None or last > done:
            self.done.update((last,))
            later = [end for end in ends if end > last]
            if later:
                self.handle.registerTimer(later[0] * 1000)
            for p in held:
                if p + self.tail <= last:  # in no later window
                    self.panes.removeKey((p,))
        if out:
            yield pd.DataFrame(out, columns=["start", "element_id", "miner_hotkey", "n", "avg_score"])


def sliding_scores_stream(df: DataFrame, tail: int, tempo: int, late: str = "1 hour") -> DataFrame:
    """sliding_scores() of a stream with ts: each window once, in append mode, when the watermark passes its end. State holds panes, never rows."""
    timed = df.withWatermark("ts", late).withColumn("pane", _pane(tempo)).select("element_id", "miner_hotkey", "pane", "score", "ts")
    schema = "start timestamp, element_id string, miner_hotkey string, n bigint, avg_score double"
    return timed.groupBy("element_id", "miner_hotkey").transformWithStateInPandas(Panes(tail, tempo), schema, "Append", "EventTime")


def dedup_stream(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each (validator, miner, element, challenge): the first that arrives. In batch the last one wins (challenge_map)."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["validator_hotkey", "miner_hotkey", "element_id", "challenge_id"])


class _Keyed(StatefulProcessor):
    """One value of state for each key; rows of a batch are taken in (block, seq) order."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("s", self.STATE)

    def close(self) -> None:
        pass

    def rows(self, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(batches)).sort_values(["block", "seq"], ignore_index=True)


class Ewma(_Keyed):
    STATE = "mean double, n bigint"

    def __init__(self, half_life: float):
        self.keep = 2.0 ** (-1.0 / half_life)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mean, n = self.state.get() if self.state.exists() else (None, 0)
        for v in self.rows(rows)["score"]:
            mean, n = (float(v), 1) if mean is None else (self.keep * mean + (1 - self.keep) * float(v), n + 1)
        self.state.update((mean, n))
        yield pd.DataFrame({"element_id": [key[0]], "miner_hotkey": [key[1]], "ewma": [mean], "n": [n]})


class Streak(_Keyed):
    STATE = "fails bigint"

    def __init__(self, limit: float, most: int):
        self.limit, self.most = limit, most

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fails = int(self.state.get()[0]) if self.state.exists() else 0
        out = []
        for seq, v in self.rows(rows)[["seq", "latency_ms"]].itertuples(index=False):
            fails = 0 if v <= self.limit else fails + 1
            out.append((key[0], key[1], int(seq), fails, "PASS" if not fails else "FAIL_LATENCY" if fails >= self.most else "PENDING_LATENCY"))
        self.state.update((fails,))
        yield pd.DataFrame(out, columns=["element_id", "miner_hotkey", "seq", "streak", "status"])


class WarmupTrim(StatefulProcessor):
    """Rows of a commit wait until the watermark passes them, and go out in (block, seq) order without up to `most` leading zeros; once a commit has shown a score or enough rows, its rows no longer wait."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block bigint, seq bigint, score double, at bigint")
        self.past = handle.getValueState("past", "n bigint, open boolean")

    def close(self) -> None:
        pass

    def _out(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r[:3]) for r in rows], columns=["element_id", "miner_hotkey", "commit_block", "block", "seq", "score"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        through, kept = [], []
        n, open_ = self.past.get() if self.past.exists() else (0, True)
        for part in rows:
            for block, seq, score, at, recent in part[["block", "seq", "score", "at", "recent"]].itertuples(index=False):
                (kept if recent and open_ and n < self.most else through).append((int(block), int(seq), float(score), int(at)))
        if kept:
            self.waiting.appendList(kept)
            self.handle.registerTimer(min(r[3] for r in kept) + 1)
        if through:
            yield self._out(key, through)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentWatermarkInMs())
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[3] < now], [r for r in rows if r[3] >= now]
        n, open_ = self.past.get() if self.past.exists() else (0, True)
        out = []
        for r in due:
            n, open_ = n + 1, open_ and abs(r[2]) <= 1e-12
            if not open_ or n > self.most:
                out.append(r)
        self.past.update((n, open_))
        if not open_ or n >= self.most:
            out, rest = out + rest, []
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[3] for r in rest) + 1)
        else:
            self.waiting.clear()
        if out:
            yield self._out(key, out)


def _run(df: DataFrame, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """Needs the RocksDB state store provider."""
    return df.groupBy("element_id", "miner_hotkey").transformWithStateInPandas(processor, schema, mode, "None")


def ewma_stream(df: DataFrame, half_life: float) -> DataFrame:
    return _run(df, Ewma(half_life), "element_id string, miner_hotkey string, ewma double, n bigint", "Update")


def streak_stream(df: DataFrame, limit: float, most: int = 3) -> DataFrame:
    return _run(df, Streak(limit, most), "element_id string, miner_hotkey string, seq bigint, streak bigint, status string", "Append")


def warmup_stream(df: DataFrame, head: int, window_blocks: int = 3 * BLOCKS_PER_DAY, most: int = 5, late: str = "1 hour") -> DataFrame:
    """select.warmup_trim() on a stream with ts: (element_id, miner_hotkey, commit_block, block, seq, score), in any order of arrival within `late`.

    head: the block that commits are aged against (a batch takes the newest one of its look-back). Rows of the private lane,
    of unknown and of older commits pass at once. Counts are kept by commit; a batch counts by miner after it kept the newest commit.
    """
    recent = (F.col("lane") != "private") & F.col("commit_block").isNotNull() & (F.lit(head) - F.col("commit_block") <= window_blocks)
    timed = df.withWatermark("ts", late).select("element_id", "miner_hotkey", F.col("commit_block").cast("bigint").alias("commit_block"), "block", "seq", F.col("score").cast("double").alias("score"), "ts", F.unix_millis("ts").alias("at"), F.coalesce(recent, F.lit(False)).alias("recent"))
    schema = "element_id string, miner_hotkey string, commit_block bigint, block bigint, seq bigint, score double"
    return timed.groupBy("element_id", "miner_hotkey", "commit_block").transformWithStateInPandas(WarmupTrim(most), schema, "Append", "EventTime")


def upsert_writer(path: str, compact: int = 8):
    """A foreachBatch function that merges each batch (hotkey, element_id, commit_block, seen, status) into the failures known so far (see merge_failed_tuples).

    A batch writes its own rows only, as path/delta/batch=N; of its rows of a tuple the newest counts. Every `compact` batches
    the state is written whole as path/base/batch=N, and what is older than the base before it is removed. A batch that is
    run again writes the same rows again, or nothing where a base holds them already.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bases = _versions(spark, f"{path}/base")
        if bases and bases[-1] >= epoch:
            return
        news = batch.groupBy("hotkey", "element_id", "commit_block").agg(F.max_by(F.struct("seen", "status"), F.struct("seen", "status")).alias("r")).select("hotkey", "element_id", "commit_block", "r.*")
        news.write.mode("overwrite").parquet(f"{path}/delta/batch={epoch}")
        last = bases[-1] if bases else -1
        if len([n for n in _versions(spark, f"{path}/delta") if n > last]) >= compact:
            read_upserts(spark, path, epoch + 1).write.mode("overwrite").parquet(f"{path}/base/batch={epoch}")
            for kind, old in (("base", [n for n in bases if n < last]), ("delta", [n for n in _versions(spark, f"{path}/delta") if n <= last])):
                for n in old:
                    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/batch={n}")
                    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return write


UPSERTS = "hotkey string, element_id string, commit_block bigint, first_seen bigint, last_seen bigint, status string"
DELTA = "hotkey string, element_id string, commit_block bigint, seen bigint, status string"


def _versions(spark, path: str) -> list[int]:
    """The batches whose folders below path are complete, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_upserts(spark, path: str, before: int | None = None) -> DataFrame:
    """The failures after all batches (those earlier than `before`): the newest base, and the deltas after it merged in their order."""
    upto = lambda kind: [n for n in _versions(spark, f"{path}/{kind}") if before is None or n < before]
    bases = upto("base")
    known = spark.read.schema(UPSERTS).parquet(f"{path}/base/batch={bases[-1]}") if bases else spark.createDataFrame([], UPSERTS)
    for n in upto("delta"):
        if not bases or n > bases[-1]:
            known = merge_failed_tuples(known, spark.read.schema(DELTA).parquet(f"{path}/delta/batch={n}"))
    return known
