"""Best-fit packing by bin completion.

Lengths are integers of 1 to the sequence length, so a corpus of any size is a histogram of that many counts. The
driver solves the histogram (at most 4,096 rows) into patterns with repeat counts; Spark then deals the pieces, ranked
within their length, to the slots of the patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, give_back, stash
from .tokens import encoder, vocabulary_path

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _reach(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """Bitsets of the sums up to `room` that the last k of the descending sizes can make, for every k."""
    out, mask = [1], (1 << (room + 1)) - 1
    for s in reversed(sizes):
        now, left, k = out[-1], min(counts[s], room // s), 1
        while left > 0:
            take = min(k, left)
            now |= (now << (s * take)) & mask
            left -= take
            k *= 2
        out.append(now)
    return out


def _of_sum(sizes: list[int], counts: list[int], below: list[int], total: int) -> Iterator[list[int]]:
    """All multisets of items with this sum, larger items first; only branches that can still reach it are entered."""

    def go(i: int, need: int, taken: list[int]) -> Iterator[list[int]]:
        if need == 0:
            yield taken
            return
        for k in range(i, len(sizes)):
            if not below[len(sizes) - k] >> need & 1:
                return
            s = sizes[k]
            for times in range(min(counts[s], need // s), 0, -1):
                if below[len(sizes) - k - 1] >> (need - s * times) & 1:
                    yield from go(k + 1, need - s * times, taken + [s] * times)

    return go(0, total, [])


def _dominated(filling: list[int], counts: list[int], room: int, present: int) -> bool:
    """Whether an item left out can take the place of smaller ones (or of several of its own size in sum) and still fit."""
    slack, one, wide = room - sum(filling), 0, 0  # bitsets of the sums of one item, and of several
    left = present
    for s in filling:
        wide |= (one | wide) << s
        one |= 1 << s
    for s in set(filling):
        if counts[s] == filling.count(s):
            left &= ~(1 << s)
    if left & ((2 << slack) - 2):  # something still fits
        return True
    step = 0
    for s in set(filling):  # one item for a larger one
        if (left >> (s + 1)) & ((1 << slack) - 1):
            return True
    while step < slack:  # several for one of their sum, up to the slack more
        by = min(step + 1, slack - step)
        wide |= wide << by
        step += by
    return bool(wide & left)


def fillings(counts: list[int], room: int, most_waste: int) -> Iterator[list[int]]:
    """The undominated fillings of `room` that leave at most `most_waste` free, least waste first, larger items first.

    A filling is dominated where an item left out could stand in for some of its items and still fit; a best packing
    with the dominated one can be turned into one with the other. Bitsets of reachable sums give the sums to try.
    """
    sizes = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s]]
    if not sizes:
        if room <= most_waste:
            yield []
        return
    below = _reach(sizes, counts, room)
    present = sum(1 << s for s in sizes)
    for total in range(room, max(-1, room - most_waste - 1), -1):
        if below[-1] >> total & 1:
            if total < room and (present & ((2 << (room - total)) - 2)) and all(counts[s] > room // s for s in sizes if s <= room - total):
                return  # there is always one more item that fits
            for f in _of_sum(sizes, counts, below, total):
                if not _dominated(f, counts, room, present):
                    yield f


def _greedy(counts: list[int], size: int) -> list[tuple[list[int], int]]:
    """Best fit around the largest item; a pattern is repeated while its items last."""
    counts, out = list(counts), []
    for largest in range(size, 0, -1):
        while counts[largest]:
            counts[largest] -= 1
            room = size - largest
            if 0 < room < len(counts) and counts[room]:
                best = [room]
            else:
                sizes = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s]]
                below = _reach(sizes, counts, room)
                best = next(_of_sum(sizes, counts, below, below[-1].bit_length() - 1))
            pattern = [largest, *best]
            counts[largest] += 1
            uses = {s: pattern.count(s) for s in set(pattern)}
            times = min(counts[s] // k for s, k in uses.items())
            for s, k in uses.items():
                counts[s] -= k * times
            out.append((pattern, times))
    return out


def least_bins(counts: list[int], size: int) -> int:
    """A lower bound: items over size - k stand alone, items over half the size never share, and what small ones of k or more do not find room for beside them needs bins by volume; the best over all k."""
    c = np.array(counts, dtype=object)  # exact integers of any size
    s = np.arange(len(c))
    number, volume = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * s)])
    half = size // 2
    best = -(-int(volume[-1]) // size)
    for k in range(1, half + 1):
        alone = number[-1] - number[min(len(c), size - k + 1)]
        pairs = number[min(len(c), size - k + 1)] - number[half + 1]
        beside = pairs * size - (volume[min(len(c), size - k + 1)] - volume[half + 1])
        small = volume[half + 1] - volume[k]
        best = max(best, int(alone + pairs + max(0, -(-(small - beside) // size))))
    return best


@dataclass
class Packing:
    patterns: list[tuple[list[int], int]]  # descending lengths and how many sequences hold them
    sequences: int
    lower: int  # no packing has fewer sequences
    proved: bool  # sequences is the least number there is


def solve(counts: list[int], size: int, nodes: int = 20_000, searched: int = 400) -> Packing:
    """Packs counts[length] items; counts has size + 1 entries.

    Best fit is the incumbent. Where it misses the lower bound, bins are dissolved, those with waste first, until about
    `searched` items are free, and packed again by bin completion: depth first over the undominated fillings of the
    largest item's bin, a branch ending when its waste exceeds what one bin less allows. With at most `searched`
    items that is all of them, and a finished search is a proof. `nodes` bounds the bins tried; whatever is left
    undone, all items are packed, and sequences - lower is the most that could still be gained.
    """
    best = _greedy(counts, size)
    used, lower = sum(t for _, t in best), least_bins(counts, size)
    if used <= lower:
        return Packing(best, used, lower, True)
    order = sorted(range(len(best)), key=lambda i: (sum(best[i][0]) - size, -i))  # most waste first, then the last found
    kept, rest, items = dict(enumerate(best)), [0] * (size + 1), 0
    for i in order:
        if items >= searched:
            break
        pattern, times = kept.pop(i)
        back = min(times, max(1, (searched - items) // len(pattern)))
        if back < times:
            kept[i] = (pattern, times - back)
        for s in pattern:
            rest[s] += back
        items += back * len(pattern)
    incumbent: list[list[int]] = [p for p, t in _greedy(rest, size) for _ in range(t)]
    fixed, volume = sum(t for _, t in kept.values()), sum(s * c for s, c in enumerate(rest))
    floor, budget = least_bins(rest, size), nodes

    def search(left: list[int], bins: list[list[int]], waste: int) -> None:
        nonlocal incumbent, budget
        spare = (len(incumbent) - 1) * size - volume - waste
        if spare < 0 or len(incumbent) <= floor:
            return
        largest = next((s for s in range(size, 0, -1) if left[s]), 0)
        if not largest:
            incumbent = bins
            return
        left[largest] -= 1
        for filling in fillings(list(left), size - largest, spare):
            budget -= 1
            if budget < 0:
                break
            for s in filling:
                left[s] -= 1
            search(left, [*bins, [largest, *filling]], waste + size - largest - sum(filling))
            for s in filling:
                left[s] += 1
            if (len(incumbent) - 1) * size - volume - waste < 0 or len(incumbent) <= floor:
                break
        left[largest] += 1

    search(rest, [], 0)
    patterns = [*kept.values(), *((p, 1) for p in incumbent)]
    if fixed + len(incumbent) > used:
        patterns = best
    used = sum(t for _, t in patterns)
    whole = not kept and budget >= 0
    return Packing(patterns, used, used if whole else lower, whole or used <= lower)


def slots(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, items of that length in a sequence, offset of the first): where the pieces of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            rows.append((s, used.get(s, 0), sequence, k, offset))
            used[s] = used.get(s, 0) + k * times
            offset += k * s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(vocabulary: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what stages before have left, and what reading the vocabulary leaves
        encode = encoder(vocabulary)
        give_back()
        for b in batches:
            names = b.column(0).to_pylist()
            for row, ids, at in encode(b.column(1), CHUNK // 4):
                doc, piece, start, length, crc = [], [], [], [], []
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]].astype("<u4"), np.uint32(end_id)).astype("<u4", copy=False)
                    for k in range(0, len(own), size):
                        part = own[k : k + size]
                        doc.append(names[row + i])
                        piece.append(k // size)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return run


def _place(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(table[:, 0], np.arange(table[:, 0].max(initial=0) + 2))
        stride = int(table[:, 1].max(initial=0)) + 1
        key = table[:, 0] * stride + table[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            if len(first) > 1 and b.num_rows:
                at = np.searchsorted(key, length * stride + np.minimum(rank, stride - 1), "right") - 1
                far = rank - table[at, 1]
                sequence, offset = table[at, 2] + far // table[at, 3], table[at, 4] + far % table[at, 3] * length
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, end_id: int = 1, size: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document in its place.

    Null and empty texts are a piece of the end id alone. Only documents over `size` ids are cut. Null ids are kept and
    repeated ids are separate documents. An empty table gives no rows. Other columns are ignored.
    """
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    docs = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    pieces = stash(docs.mapInArrow(_pieces(vocabulary, end_id, size), PIECES))
    counts = [0] * (size + 1)
    for r in pieces.groupBy("length").count().collect():  # at most `size` rows
        counts[r["length"]] = r["count"]
    table = slots(solve(counts, size).patterns)

    salted = pieces.withColumn("salt", F.expr("int(pmod(xxhash64(doc_id, piece, ids_crc32), 64))"))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("k", number).join(before.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k") - 1).cast("bigint").alias("rank"))
    return ranked.mapInArrow(_place(table), PIECES + ", sequence_id bigint, offset bigint")
