"""Shared helpers: Arrow text buffers as numpy bytes, word spans, rolling hashes, written tables, id ranges."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20  # bytes of text handled by one round of numpy work

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240501)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {"n": np.zeros(0, np.uint64), "i": np.zeros(0, np.uint64)}


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset a local session gets a folder of its own (one machine reads it all), and a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scoregrid-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of 2,000 rows, so that whole texts of several kilobytes stay a few megabytes in each worker; called by the queries, not by the operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def drop_shuffles(spark: SparkSession) -> SparkSession:
    """Shuffle files go when the execution that wrote them ends, not when the JVM next collects garbage; called by queries of many written tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stash_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more (all that came of them has been written too)."""
    for df in frames:
        spark, path = df.sparkSession, df.stash_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows (null: empty) and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


GIVE_BACK = 4 << 20  # bytes of text between two returns of freed memory, in one batch or in several
_HANDLED = {"bytes": 0}


def give_back() -> None:
    """Ask Arrow and the C library to return freed memory to the system; workers live longer than their tasks."""
    _HANDLED["bytes"] = 0
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that hold about `limit` bytes; a longer text is a run of its own."""
    buf, offs = text_bytes(column)
    i, n = 0, len(offs) - 1
    while i < n:
        if _HANDLED["bytes"] >= GIVE_BACK:
            give_back()
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        _HANDLED["bytes"] += int(offs[j] - offs[i])
        yield i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["n"]) < n:
        m = max(n, CHUNK + 1)
        for k, base in (("n", BASE), ("i", pow(BASE, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p)
    return _POW["n"][:n], _POW["i"][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by one prefix sum over the buffer; equal bytes give equal hashes anywhere."""
    p, inv = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words `[^\\x20\\x09-\\x0D]+`, and for each text the index of its first word (n + 1)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = IS_WORD[buf]
    edge = offs[(offs > 0) & (offs < n)]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingles(word: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words inside each text (fewer words: the whole as one), and each text's range of them."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(word))
    end, begin = first[1:][doc], first[:-1][doc]
    total, step, padded = np.zeros(len(word), np.uint64), np.uint64(1), np.concatenate([word, np.zeros(size, np.uint64)])
    for j in range(size):
        total += np.where(at + j < end, padded[j : j + len(word)] * step, np.uint64(0))
        step = np.uint64(int(step) * 0xD6E8FEB86659FD93 % (1 << 64))
    keep = (at + size <= end) | (at == begin)
    h = mix(total[keep] + np.minimum(count, size)[doc][keep].astype(np.uint64))
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(count)))]).astype(np.int64)


def id_bounds(docs: DataFrame, column: str, parts: int) -> list[int]:
    """At most `parts` - 1 ascending quantiles of an integer column: the only thing the driver holds."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx(column, at, 20_000).alias("q")).first()["q"]
    return sorted(set(got or []))


def id_range(column: Column, bounds: list[int]) -> Column:
    """The number of bounds that are <= column (null: 0), found by halving."""
    if not bounds:
        return F.lit(0)
    steps, k = [], 1
    while k <= len(bounds):
        steps.insert(0, k)
        k *= 2
    table = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) < 2 else F.from_json(F.lit(str([int(b) for b in bounds])), "array<bigint>")
    down = F.array(*[F.lit(s) for s in steps])
    return F.aggregate(down, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(table, at + s - 1) <= column, F.lit(False)), at + s).otherwise(at))


def parts_for(docs: DataFrame, column: str, per_part: int) -> int:
    """How many ranges of about `per_part` rows a table needs."""
    return max(1, -(-docs.select(column).count() // per_part))


def crc_mod(column: Column, k: int) -> Column:
    """crc32 of an id written as text, modulo k (null id: 0)."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % k, F.lit(0))


def text_key(text: Column) -> Column:
    """SHA-256 of a text as binary (null: that of the empty text)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


HOT_PARTS = 1000


def join_by_text(docs: DataFrame, values: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id of every row of docs (as bigint), with the other columns of `values` (key = text_key, copies, ...) of its text, null where it has none.

    A text that a thousandth of all copies or more share is sent to the documents; there are at most a thousand of those.
    The others are shuffled by key, and rows of sent texts go by a hash of their id instead. `values` is read three times: a
    written table.
    """
    rest = [c for c in values.columns if c not in ("key", "copies")]
    total = values.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("all")).first()["all"]
    hot = values.where(F.col("copies") * HOT_PARTS >= F.lit(total)).select(F.col("key").alias("hot_key"), F.struct(*rest).alias("hot"))
    keyed = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_key(F.col(text_column)).alias("full_key"))
    keyed = keyed.join(F.broadcast(hot), F.col("full_key") == F.col("hot_key"), "left")
    keyed = keyed.withColumn("key", F.when(F.col("hot_key").isNull(), F.col("full_key")).otherwise(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")))  # at most 20 bytes: no key
    cold = values.where(F.length("key") == 32).select("key", F.struct(*rest).alias("cold"))
    both = keyed.join(cold, "key", "left").withColumn("v", F.coalesce("hot", "cold"))
    return both.select("doc_id", *[F.col(f"v.{c}").alias(c) for c in rest])
