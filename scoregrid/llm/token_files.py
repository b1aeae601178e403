"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits. Level k holds the k-th chunk of every id that is long enough; a continuation
bitmap beside it says which ids go on, and a rank directory (ones before each 512 bits) gives the place of an id's
next chunk, so that any token is read without decoding its neighbours.

A block is one row of the written table: (part, block, start, doc_ids, lengths, codes). `part` is the document's
range of doc_id, parts and the blocks of a part are in ascending doc_id order, and `start` counts the part's ids
before the block. A block holds about BLOCK ids; a longer document is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_bounds, id_range, parts_for, scratch
from .tokens import encoder, release, vocabulary_path

BLOCK, RANK = 1 << 17, 512
BLOCKS = "part int, block int, start bigint, doc_ids array<bigint>, lengths array<bigint>, codes binary"


class DirectCodes:
    """Non-negative integers below 2^32 with access to any of them."""

    def __init__(self, levels: list[np.ndarray], bits: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.bits, self.ranks = levels, bits, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> DirectCodes:
        rest, levels, bits, ranks = ids.astype(np.uint32), [], [], []
        while True:
            more = rest > 255
            levels.append((rest & 255).astype(np.uint8))
            if not more.any():
                return cls(levels, bits, ranks)
            packed = np.packbits(more, bitorder="little")
            per = np.add.reduceat(more, np.arange(0, len(more), RANK), dtype=np.uint32)
            bits.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint32))
            rest = rest[more] >> 8

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *(len(x) for x in self.levels)], np.uint32).tobytes()
        body = [x.tobytes() for k in range(len(self.levels)) for x in ((self.levels[k], self.bits[k], self.ranks[k]) if k < len(self.bits) else (self.levels[k],))]
        return head + b"".join(body)

    @classmethod
    def from_bytes(cls, raw: bytes) -> DirectCodes:
        k = int(np.frombuffer(raw, np.uint32, 1)[0])
        sizes, at = np.frombuffer(raw, np.uint32, k, 4).astype(int), 4 * (k + 1)
        levels, bits, ranks = [], [], []
        for i, n in enumerate(sizes):
            levels.append(np.frombuffer(raw, np.uint8, n, at))
            at += n
            if i < k - 1:
                bits.append(np.frombuffer(raw, np.uint8, -(-n // 8), at))
                at += -(-n // 8)
                ranks.append(np.frombuffer(raw, np.uint8, 4 * -(-n // RANK), at).view(np.uint32))
                at += 4 * -(-n // RANK)
        return cls(levels, bits, ranks)

    def __len__(self) -> int:
        return len(self.levels[0])

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for k, level in enumerate(self.levels):
            value |= int(level[i]) << shift
            if k == len(self.bits) or not self.bits[k][i >> 3] >> (i & 7) & 1:
                return value
            begin = i // RANK * RANK
            i = int(self.ranks[k][i // RANK]) + int(np.unpackbits(self.bits[k][begin // 8 : -(-i // 8)], bitorder="little")[: i - begin].sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        value = self.levels[-1].astype(np.uint32)
        for k in range(len(self.bits) - 1, -1, -1):
            more = np.unpackbits(self.bits[k], count=len(self.levels[k]), bitorder="little").astype(bool)
            low = self.levels[k].astype(np.uint32)
            low[more] |= value << 8
            value = low
        return value


def _blocks(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block, start = encoder(vocabulary), None, 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            lengths = [len(x) for x in ids]
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([DirectCodes.of(np.concatenate(ids)).to_bytes()], pa.binary())], ["part", "block", "start", "doc_ids", "lengths", "codes"])
            block, start, held = block + 1, start + held, 0
            docs.clear()
            ids.clear()
            return row

        for b in batches:
            parts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            for row, got, at in encode(b.column(2)):
                for i in range(len(at) - 1):
                    if docs and (parts[row + i] != part or held >= BLOCK):
                        yield flush()
                    if parts[row + i] != part:
                        part, block, start = parts[row + i], 0, 0
                    docs.append(names[row + i])
                    ids.append(np.append(got[at[i] : at[i + 1]].astype(np.uint32), np.uint32(end_id)))
                    held += len(ids[-1])
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, end_id: int = 2, per_part: int = 4000) -> None:
    """Encode every whole text (null: empty) and write its ids and `end_id` as blocks, ascending by id (null ids first, equal ids by text).

    An empty table writes a table without blocks. Columns other than the id and the text are ignored, whatever their
    names. Parquet pages stay uncompressed, so that a block's bytes lie in the file as they are.
    """
    docs = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    parts = min(16384, parts_for(docs, "id", per_part))
    cut = docs.withColumn("part", id_range(F.col("id"), id_bounds(docs, "id", parts)).cast("int")).select("part", "id", "text")
    cut = cut.repartition(max(1, parts // 2), "part").sortWithinPartitions("part", "id", F.xxhash64("text"))
    cut.mapInArrow(_blocks(vocabulary or vocabulary_path("byte_bpe_50k.json"), end_id), BLOCKS).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary as uint32) for each document of a written table; digest: ids_crc32 in the place of ids.

    Null ids and repeated ids come back as they were written, a row each; a table without blocks gives no rows.
    """
    table = spark.read.schema(BLOCKS).parquet(path)
    sums = table.select("part", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()  # at most 16,384 parts
    before, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # reading needs no encoder
        give_back()
        for b in batches:
            for part, start, docs, lengths, codes in zip(*(b.column(k) for k in (0, 2, 3, 4, 5)), strict=True):
                ids, n = DirectCodes.from_bytes(codes.as_py()).all().astype("<u4", copy=False), lengths.values.to_numpy()
                end = np.cumsum(n)
                first = before[part.as_py()] + start.as_py() + end - n
                each = (ids[e - k : e] for e, k in zip(end, n, strict=True))
                last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array([x.tobytes() for x in each], pa.binary())
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(first), pa.array(n), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return table.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids binary"))


def read_tokens(spark, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, position, token) for each distinct row (doc_id, position) of `wanted` that a written table holds.

    Only the blocks with a wanted document are read further, and in them each id is reached through its levels,
    bitmaps and ranks; none of its neighbours is decoded. Positions beyond a document's end, null ids and documents
    that are not there give no row. Documents that share an id give a row each.
    """
    table = spark.read.schema(BLOCKS).parquet(path)

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block, docs, lengths in zip(*b.columns, strict=True):
                n = lengths.values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(n), pa.int32()), pa.array([block.as_py()] * len(n), pa.int32()), docs.values, pa.array(n), pa.array(np.cumsum(n) - n)], ["part", "block", "doc_id", "length", "begin"])

    index = table.select("part", "block", "doc_ids", "lengths").mapInArrow(index_rows, "part int, block int, doc_id bigint, length bigint, begin bigint")
    asked = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("position").cast("bigint").alias("position")).distinct()
    at = index.join(asked, "doc_id").where("position >= 0 and position < length")
    at = at.groupBy("part", "block").agg(F.collect_list(F.struct("doc_id", "position", (F.col("begin") + F.col("position")).alias("place"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, raw in zip(b.column(0), b.column(1), strict=True):
                codes, rows = DirectCodes.from_bytes(raw.as_buffer()), places.values
                got = [codes[i] for i in rows.field("place").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.field("doc_id"), rows.field("position"), pa.array(got, pa.int64())], ["doc_id", "position", "token"])

    return table.select("part", "block", "codes").join(at, ["part", "block"]).select("places", "codes").mapInArrow(run, "doc_id bigint, position bigint, token bigint")


def token_digest(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of each document's ids, from the files that write_ids wrote."""
    path = scratch(docs.sparkSession)
    write_ids(docs, path)
    return read_ids(docs.sparkSession, path, digest=True)
