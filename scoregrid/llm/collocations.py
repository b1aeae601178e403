"""Phrase collocations by dynamic itemset counting.

The texts are dealt to shards, and shards are scanned in a cycle. Words are counted from the first scan on. A longer phrase
becomes active in the scan after both its subphrases (without its last and without its first word) have reached the
threshold, whatever their length, so lengths interleave; it is counted for exactly one full cycle of shards and then
complete. The threshold of one scan is a shard's share of the least count, least / shards: a phrase with the least count
has that many in one shard or more, so no such phrase and none of its subphrases is missed, and one scan's counts decide. Counts of at most a third of the threshold are not kept: a phrase loses at most that in each of the
other shards, and one that may have the least count with its losses stays, to be counted whole at the end.

What a scan needs to know is the scan in which each phrase reached the threshold. That is one byte in a table of up
to 2^MOST_BITS slots, addressed by the phrase's hash and kept for the whole run. Phrases that share a slot take the
earlier scan: then a phrase may become active although a subphrase is rare, and is still counted for exactly one cycle.

Scans count hashes. Those whose cycle may give the least count are spelled in a last pass over the texts, which counts them
whole and by their words. It knows them by two bits in a byte a slot; a rare phrase that has the same bits is counted too, and
left out by its count. A task spells a phrase where it meets it first and hands it on once, so that what is shuffled is a
task's distinct phrases. (Inside one task phrases are told apart by 62 bits of hash and their length, across tasks by words.)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import discard, mix, scratch, span_hashes, stash, text_chunks

LONGEST = 4
MOST_BITS = 26
NEVER = 255
HELD = 2_000_000  # phrases that a task holds before it hands its counts on
COUNTED = "h bigint, c bigint"
SPELLED = "h bigint, k int, lang string, phrase string, c bigint"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = 0xD6E8FEB86659FD93


def pieces(text: Column) -> Column:
    """The text with A-Z lower-cased, one line a piece and one space between words (null: empty)."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_replace(F.regexp_replace(lower, r"[.,;:!?\x0A-\x0D]", "\n"), r"[ \t]+", " ")


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the text of each, and a number that differs between pieces."""
    inside = (buf != 0x20) & (buf != 0x0A)
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    edge = offs[(offs > 0) & (offs < len(buf))]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, text, np.cumsum(buf == 0x0A)[starts] + text


class _Held:
    """Counts by phrase hash."""

    def __init__(self) -> None:
        self.h, self.c, self.size = [], [], 0

    def add(self, h: np.ndarray, c: np.ndarray) -> None:
        self.h.append(h)
        self.c.append(c)
        self.size += len(h)

    def pack(self) -> None:
        """One row a hash."""
        code, h = pd.factorize(np.concatenate(self.h))
        self.h, self.c, self.size = [h], [np.bincount(code, np.concatenate(self.c), len(h)).astype(np.int64)], len(h)

    def full(self, most: int) -> bool:
        """Whether, with one row a hash, it holds over half of `most`; looked at where it holds more rows than `most`."""
        if self.size <= most:
            return False
        self.pack()
        return self.size > most // 2

    def drain(self, names: list[str]) -> pa.RecordBatch:
        self.pack()
        out = pa.RecordBatch.from_arrays([pa.array(self.h[0].view(np.int64)), pa.array(self.c[0])], names)
        self.__init__()
        return out


class _Spellings:
    """Counts by phrase hash of whole tasks: a phrase is spelled where it is met first, and only counted from then on."""

    def __init__(self) -> None:
        self.h, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the hashes in order, and the row of each
        self.rows, self.c, self.size = [], np.zeros(0, np.int64), 0

    def new(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts distinct ascending hashes, and says which of them are to be spelled, by append()."""
        place = np.searchsorted(self.h, h)
        new = self.h[np.minimum(place, self.size - 1)] != h if self.size else np.ones(len(h), bool)
        self.c[self.at[place[~new]]] += c[~new]
        self.c = np.concatenate([self.c, c[new]])
        self.h, self.at = np.insert(self.h, place[new], h[new]), np.insert(self.at, place[new], self.size + np.arange(new.sum()))
        self.size = len(self.h)
        return new

    def append(self, columns: list[pa.Array], names: list[str]) -> None:
        """Further columns of the hashes that new() named."""
        self.rows.append(pa.RecordBatch.from_arrays(columns, names))

    def drain(self) -> Iterator[pa.RecordBatch]:
        i = 0
        for b in self.rows:
            yield b.append_column("c", pa.array(self.c[i : i + b.num_rows]))
            i += b.num_rows
        self.__init__()


def _strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    length = ends - starts
    at = np.concatenate([[0], np.cumsum(length)])
    raw = buf[np.repeat(starts - at[:-1], length) + np.arange(at[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes()))


def _phrases(b: pa.RecordBatch, limit: int) -> Iterator[tuple]:
    """For runs of texts in a batch (seed, lang, text) and each length: (k, hash of the phrase at each word, whether it lies in one piece, buffer, starts, ends, batch row of each word).

    The lowest two bits of a hash are k - 1.
    """
    seeds = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    for row, buf, offs in text_chunks(b.column(2), limit):
        if not len(buf):
            continue
        starts, ends, text, piece = _words(buf, offs)
        word = span_hashes(buf, starts, ends)
        seed, total, factor = seeds[row + text], word, np.uint64(1)
        for k in range(1, min(LONGEST, len(word)) + 1):
            m = len(word) - k + 1
            if k > 1:
                factor = np.uint64(int(factor) * _STEP % (1 << 64))
                total = total[:m] + word[k - 1 :] * factor
            h = mix(total + seed[:m] * np.uint64(2 * k + 1))
            yield k, h >> np.uint64(2) << np.uint64(2) | np.uint64(k - 1), piece[:m] == piece[k - 1 :], buf, starts, ends, row + text


def _scan(step: int, shards: int, bits: int, table: Broadcast):
    """Counts of the phrases that are active in scan `step`, in the batches of its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, held, when = np.frombuffer(table.value, np.uint8), _Held(), None
        for b in batches:
            for k, h, whole, *_ in _phrases(b, 1 << 22):
                begins = np.zeros(len(h), np.int16) if k == 1 else 1 + np.maximum(when[:-1], when[1:]).astype(np.int16)
                active = h[whole & (begins <= step) & (step < begins + shards)]
                when = np.where(whole, reached[h >> np.uint64(64 - bits)], np.uint8(NEVER))
                if len(active):
                    code, distinct = pd.factorize(active)
                    held.add(distinct, np.bincount(code))
                if held.full(HELD):
                    yield held.drain(["h", "c"])
        if held.size:
            yield held.drain(["h", "c"])

    return run


def _marks(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of a byte that stand for a hash in its slot (as one number; they may fall together)."""
    first, second = (h >> np.uint64(64 - bits - 3 * i) & np.uint64(7) for i in (1, 2))
    return (np.uint64(1) << first | np.uint64(1) << second).astype(np.uint8)


def _marked(found: DataFrame, bits: int) -> np.ndarray:
    """A byte a slot with the marks of the hashes in it: as _marks() makes them."""
    mark = [F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - bits - 3 * i}) & 7 as int))") for i in (1, 2)]
    slot = F.shiftrightunsigned("h", 64 - bits).cast("int").alias("slot")
    got = found.groupBy(slot).agg(F.bit_or(mark[0].bitwiseOR(mark[1])).cast("short").alias("marks")).toArrow()  # at most 2^MOST_BITS rows
    wanted = np.zeros(1 << bits, np.uint8)
    wanted[got["slot"].to_numpy()] = got["marks"].to_numpy()
    return wanted


def _spell(bits: int, table: Broadcast):
    """The phrases whose marks are all in their slot, counted, and for each language a row without a phrase that counts its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, names = np.frombuffer(table.value, np.uint8), _Spellings(), ["h", "k", "lang", "phrase", "c"]
        for b in batches:
            lang = b.column(1)
            for k, h, whole, buf, starts, ends, row in _phrases(b, 1 << 20):
                if k == 1:
                    code, seen = pd.factorize(lang.take(pa.array(row)).to_numpy(zero_copy_only=False))
                    n = len(seen)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(seen, pa.string()), pa.nulls(n, pa.string()), pa.array(np.bincount(code, minlength=n))], names)
                there = wanted[h >> np.uint64(64 - bits)]
                found = np.flatnonzero(whole & (there != 0))
                marks = _marks(h[found], bits)
                found = found[there[found] & marks == marks]
                if len(found):
                    code, distinct = pd.factorize(h[found])
                    first = np.zeros(len(distinct), np.int64)
                    first[code[::-1]] = found[::-1]
                    order = np.argsort(distinct)
                    new = order[held.new(distinct[order], np.bincount(code)[order])]
                    at = first[new]
                    held.append([pa.array(distinct[new].view(np.int64)), pa.array(np.full(len(new), k, np.int32)), lang.take(pa.array(row[at])), _strings(buf, starts[at], ends[at + k - 1])], names[:-1])
                if held.size > HELD:
                    yield from held.drain()
        yield from held.drain()

    return run


def _slots(found: DataFrame, bits: int) -> np.ndarray:
    """The distinct slots of hashes: at most 2^MOST_BITS numbers."""
    return found.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()


def count_phrases(docs: DataFrame, least: int = 30, shards: int = 4, text_column: str = "text", lang_column: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of every phrase of one to four words with f >= least, (lang, n) with the number of words), of written tables.

    Null languages are `und`, null texts empty. Languages and texts are taken whole; a table without words gives no rows.
    """
    spark, seen, root = docs.sparkSession, Observation(), scratch(docs.sparkSession)
    lang = F.coalesce(F.col(lang_column), F.lit("und"))
    dealt = docs.select(F.pmod(F.xxhash64(*docs.columns[:1], text_column, lang_column), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(lang).alias("seed"), lang.alias("lang"), pieces(F.col(text_column)).alias("text"))
    dealt.observe(seen, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).write.partitionBy("shard").parquet(f"{root}/shards")
    texts = spark.read.schema("seed bigint, lang string, text string, shard int").parquet(f"{root}/shards")
    bits = min(MOST_BITS, max(16, int(np.log2(seen.get["bytes"] / 60 + 1)) + 1))
    reached = np.full(1 << bits, NEVER, np.uint8)
    step, end, share = 0, shards, -(-least // shards)
    low = share // 3  # a scan's counts up to this are not written
    tables: list[DataFrame] = []
    while step < end:
        sent = spark.sparkContext.broadcast(reached.tobytes())
        found = texts.where(F.col("shard") == step % shards).select("seed", "lang", "text").mapInArrow(_scan(step, shards, bits, sent), COUNTED)
        tables.append(stash(found.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > low)))
        sent.destroy()
        slots = _slots(tables[-1].where(F.col("h").bitwiseAND(3) < LONGEST - 1).where(F.col("c") >= share), bits)
        new = slots[reached[slots] == NEVER]
        if len(new):
            reached[new] = step
            end = max(end, step + 1 + shards)
        step += 1
    every = reduce(DataFrame.unionByName, tables).repartition("h")
    likely = every.groupBy("h").agg(F.max("c").alias("most"), F.sum("c").alias("c")).where((F.col("most") >= share) & (F.col("c") >= least - low * (shards - 1)))
    wanted = _marked(likely, bits)
    discard(*tables)
    sent = spark.sparkContext.broadcast(wanted.tobytes())
    spelled = texts.select("seed", "lang", "text").coalesce(max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // 4)).mapInArrow(_spell(bits, sent), SPELLED)
    # summed by task before they are dealt: a phrase is sent once a task; others with its marks have less than the least count
    spelled = stash(spelled.groupBy("lang", "phrase", "k").agg(F.sum("c").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least)))
    return spelled.where(F.col("phrase").isNotNull()), spelled.where("phrase is null").select("lang", F.col("f").alias("n"))


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, shards: int = 4, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate's score is that of its lowest cut, 2,000,000 * a / (l + r) rounded down; candidates within a longer one that
    has at least 0.8 of their count are dropped. Ties end with the phrase's bytes. Null languages are `und`, null texts empty;
    repeated rows count as often as they stand; other columns are ignored. The ranking takes the first of 256 parts of a
    language before those of the whole.
    """
    frequent, words = count_phrases(docs, least, shards, text_column, lang_column)
    candidates = frequent.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("rest"))
    part = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    inner = candidates.where("k >= 3").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(w, i, s), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (_exact(F.col("most")) * 100 < _exact(F.col("a")) * 80))
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return kept.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
