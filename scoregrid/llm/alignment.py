"""Cross-tokenizer alignment of distinct texts: which tokens of one vocabulary share bytes with which of another.

Texts are shuffled by their full text, so that each distinct text is tokenised and aligned once, whatever its number of
copies. Byte offsets where tokens of both end cut a text into groups; every token of A in a group is linked with every
token of B in it. A pair of ids is counted once for a text that holds it, times the text's multiplicity. The measures of
a text are joined back to the doc_ids.

A worker cuts texts where both tokenizers cut (before a single space, around line ends) and keeps the alignment of the
segments that it has met, up to KEEP of them; a text's groups are those of its segments in a row.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, discard, join_by_text, span_hashes, stash, text_chunks, text_key
from .tokens import vocabulary_path

KEEP = 1_000_000
SENT_PAIRS = 1_500_000  # up to so many id pairs are sent to every executor; beyond, both sides are shuffled by the pair
PIECE_BITS = 15
_OPEN = np.zeros(256, bool)  # bytes that begin a character which is no white space, ASCII or U+00C0 to U+07FF
_OPEN[0x21:0x7F] = True
_OPEN[0xC3:0xE0] = True
ALIGNED = "key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>"


def _byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: itself where it prints, else the next free one from U+0100."""
    out, free = {}, 256
    for b in range(256):
        prints = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out[chr(b if prints else free)] = b
        free += not prints
    return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All of start[i], start[i] + 1, ... (length[i] of them), one after another."""
    total = np.concatenate([[0], np.cumsum(length)])
    return np.repeat(start - total[:-1], length) + np.arange(total[-1])


def _summed(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes ascending, with the sums of their times."""
    order = np.argsort(code, kind="stable")
    code, times = code[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(times, first) if len(first) else times


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and all their items."""
    count = np.array([len(x) for x in lists], np.int64)
    return count, np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum()))


class _Strings:
    """A table of byte strings by id."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(x) for x in strings], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, ids: np.ndarray, room: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ids one after another, each with `room` free bytes behind it, and their lengths."""
        length = self.length[ids]
        out = np.zeros(int(length.sum()) + room * len(ids), np.uint8)
        out[_ranges(np.cumsum(length + room) - length - room, length)] = self.flat[_ranges(self.at[ids], length)]
        return out, length + room

    def same(self, lists: list[list[int]], want: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the strings of each list give the bytes want[at[i]:at[i + 1]] (never an empty span)."""
        count, ids = _flat(lists)
        size = np.concatenate([[0], np.cumsum(self.length[ids])])[np.concatenate([[0], np.cumsum(count)])]
        good = np.diff(size) == np.diff(at)
        got = self.gather(ids)[0]
        spans = np.flatnonzero(good)
        if len(spans):
            n = np.diff(at)[spans]
            equal = got[_ranges(size[spans], n)] == want[_ranges(at[spans], n)]
            good[spans] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return good


class SegmentAligner:
    """Alignments of segments under a byte-level tokenizers file (A) and a sentencepiece model (B)."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        code = _byte_alphabet()
        self.a_text = _Strings([bytes(code[c] for c in token) if token is not None and all(c in code for c in token) else (token or "").encode() for token in map(self.a.id_to_token, range(self.a.get_vocab_size()))])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > 1 << PIECE_BITS or len(self.a_text.length) > 1 << 31 - PIECE_BITS:
            raise ValueError("an id pair must fit 31 bits")
        self.b_text = _Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = _Strings([b"%d" % i for i in range(max(len(pieces), len(self.a_text.length)))])
        # no piece goes on over a space or a line end: then a text may be cut there
        self.cuts = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) and len(self.b.encode("\n")) == 2
        self.forget()

    def forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes = np.zeros((5, 0), np.int64)  # tokens of A, of B, groups, links, 1 if the bytes agree
        self.pair, self.times, self.pair_at = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.said, self.said_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _pieces(self, segments: list[bytes]) -> list[list[int]]:
        """B's ids of segments as they stand in a text: it adds a space itself, which takes the place of the first one."""
        led = [s[:1] == b" " for s in segments]
        got = self.b.encode([(s[1:] if lead else b"\n" + s).decode() for s, lead in zip(segments, led, strict=True)], num_threads=1)
        return [ids if lead else ids[2:] for ids, lead in zip(got, led, strict=True)]

    def learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Align new segments (spans of buf) and keep what came of it."""
        raw = buf.tobytes()
        segments = [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        a = [e.ids for e in self.a.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)]
        b = self._pieces(segments)
        seg, want = np.arange(len(segments)), np.concatenate([[0], np.cumsum(ends - starts)])
        bytes_of = buf[_ranges(starts, ends - starts)]
        good = self.a_text.same(a, bytes_of, want) & self.b_text.same(b, bytes_of, want)
        a, b = ([x if ok else [] for x, ok in zip(side, good.tolist(), strict=True)] for side in (a, b))
        (na, ia), (nb, ib) = _flat(a), _flat(b)
        end_a, end_b = np.cumsum(self.a_text.length[ia]), np.cumsum(self.b_text.length[ib])
        ends_of = end_a[end_b[np.minimum(np.searchsorted(end_b, end_a), max(0, len(end_b) - 1))] == end_a] if len(end_b) else end_a
        group_a, group_b = np.searchsorted(ends_of, end_a), np.searchsorted(ends_of, end_b)
        of = np.zeros(len(ends_of), np.int64)
        of[group_a] = np.repeat(seg, na)
        in_a, in_b = np.bincount(group_a, minlength=len(of)), np.bincount(group_b, minlength=len(of))
        sizes = np.stack([na, nb, np.bincount(of, minlength=len(seg)), np.bincount(of, in_a * in_b, len(seg)).astype(np.int64), good.astype(np.int64)])
        ua, ta = _summed(group_a << 32 | ia, np.ones(len(ia), np.int64))
        ub, tb = _summed(group_b << 32 | ib, np.ones(len(ib), np.int64))
        each = np.bincount(ub >> 32, minlength=len(of))
        from_b = np.concatenate([[0], np.cumsum(each)])
        reps = each[ua >> 32]
        right = _ranges(from_b[ua >> 32], reps)
        pair = np.repeat(ua & 0xFFFFFFFF, reps) << PIECE_BITS | ub[right] & 0xFFFFFFFF
        code, times = _summed(np.repeat(of[ua >> 32], reps) << 31 | pair, np.repeat(ta, reps) * tb[right])
        said, length = self._said(ia, ib, group_a, group_b)
        first = self.sizes.shape[1]
        self.sizes = np.concatenate([self.sizes, sizes], axis=1)
        self.pair = np.concatenate([self.pair, (code & 0x7FFFFFFF).astype(np.int32)])
        self.times = np.concatenate([self.times, times.astype(np.int32)])
        self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + np.cumsum(np.bincount(code >> 31, minlength=len(seg)))])
        self.said = np.concatenate([self.said, said])
        self.said_at = np.concatenate([self.said_at, self.said_at[-1] + np.cumsum(np.bincount(of, length, len(seg)).astype(np.int64))])
        keys, rows = np.concatenate([self.keys, keys]), np.concatenate([self.rows, first + seg])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]

    def _said(self, ia: np.ndarray, ib: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, each with `;` behind it, and the length of each."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([ia, ib])[order], side[order]
        last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
        out, length = self.digits.gather(ids, 1)
        out[np.cumsum(length) - 1] = np.where(last, np.where(side & 1, ord(";"), ord("|")), ord(","))
        return out, np.bincount(side >> 1, length).astype(np.int64)

    def entries(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        code, keys = pd.factorize(span_hashes(buf, starts, ends))
        spot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[spot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + len(keys) > KEEP:
                self.forget()
                known = np.zeros(len(keys), bool)
            at = np.zeros(len(keys), np.int64)
            at[code[::-1]] = np.arange(len(code))[::-1]
            self.learn(keys[~known], buf, starts[at[~known]], ends[at[~known]])
            spot = np.searchsorted(self.keys, keys)
        return self.rows[spot][code]

    def cut(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where segments begin, the end of the last one behind them."""
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        if self.cuts:
            opens, before = np.append(_OPEN[buf[1:]], False), np.concatenate([[0], buf[:-1]])
            cut[:n] |= (buf == 0x20) & opens & (before != 0x20)
            line = (buf == 0x0A) & opens & (before > 0x20) & (before < 0x7F)
            cut[:n] |= line
            cut[1:] |= line
        cut[offs] = True
        return np.flatnonzero(cut)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        """(first row, columns from n_a to times) of runs of rows."""
        for row, buf, offs in text_chunks(column, CHUNK // 2):
            n = len(offs) - 1
            buf, offs = np.insert(buf, offs[:-1], 0x20), offs + np.arange(n + 1)
            edges = self.cut(buf, offs)
            entry = self.entries(buf, edges[:-1], edges[1:])
            first = np.searchsorted(edges, offs)
            count = np.diff(first)
            text = np.repeat(np.arange(n), count)
            sizes = np.add.reduceat(self.sizes[:, entry], first[:-1], axis=1)
            whole = sizes[4] == count
            sizes[:, ~whole] = 0
            length = self.said_at[entry + 1] - self.said_at[entry]
            said, said_at = self.said[_ranges(self.said_at[entry], length)].tobytes(), np.concatenate([[0], np.cumsum(length)])[first]
            shas = [hashlib.sha256(said[said_at[i] : said_at[i + 1] - 1]).hexdigest() if whole[i] else "" for i in range(n)]
            code, times = _summed(text[whole[text]] << 32 | entry[whole[text]], np.ones(int(whole[text].sum()), np.int64))
            e = code & 0xFFFFFFFF
            length = self.pair_at[e + 1] - self.pair_at[e]
            at = _ranges(self.pair_at[e], length)
            code, times = _summed(np.repeat(code >> 32, length) << 31 | self.pair[at], np.repeat(times, length) * self.times[at])
            bounds = pa.array(np.searchsorted(code, np.arange(n + 1) << 31).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (code & 0x7FFFFFFF, times)]
            yield row, [pa.array(x) for x in sizes[:4]] + [pa.array(shas, pa.string()), *lists]


_ALIGNERS: dict[tuple[str, str], SegmentAligner] = {}


def _aligned(a_file: str, b_file: str):
    names = [c.split(" ")[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_file, b_file) not in _ALIGNERS:
            _ALIGNERS[a_file, b_file] = SegmentAligner(a_file, b_file)
        for b in batches:
            for row, columns in _ALIGNERS[a_file, b_file](b.column(2)):
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), b.column(1).slice(row, n), *columns], names)

    return run


def align_texts(docs: DataFrame, text_column: str = "text", a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """A row for each distinct text: its key (SHA-256), copies, sizes, groups_sha256, and its id pairs (A id * 2^15 + B id, ascending) with the times that it holds each.

    Null texts count as empty. A text without tokens (empty, or changed by a tokenizer) has zeros, '' and no pairs.
    """
    texts = docs.groupBy(F.coalesce(F.col(text_column), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return texts.select(text_key(F.col("text")).alias("key"), "copies", "text").mapInArrow(_aligned(a_file or vocabulary_path("byte_bpe_50k.json"), b_file or vocabulary_path("piece_bpe_32k.model")), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, count, best) for each id pair: how many documents hold it linked, and whether no pair of its A id has more."""
    counts = aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("count"))
    named = counts.select("pair", F.shiftright("pair", PIECE_BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << PIECE_BITS) - 1).alias("b_id"), "count")
    return named.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a_id")))  # an A id has at most 2^15 pairs


def alignment_of_all(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures of each document, a row for each row of docs.

    Null ids and repeated rows keep a row each and count as documents of their own; other columns are ignored, whatever
    their names; an empty table gives no rows. Very long texts are aligned whole.
    """
    aligned = stash(align_texts(docs, text_column))
    counts = stash(pair_counts(aligned)).select("pair", "count", "best")
    if counts.count() <= SENT_PAIRS:
        counts = F.broadcast(counts)
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("key", F.col("l.pairs").alias("pair"), F.col("l.times").cast("bigint").alias("times"))
    sums = links.join(counts, "pair").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    sizes = ("n_a", "n_b", "n_groups", "n_links")
    measures = stash(aligned.select("key", "copies", *sizes, "groups_sha256").join(sums, "key", "left"))
    discard(aligned)
    told = join_by_text(docs, measures, id_column, text_column)
    return told.select("doc_id", *sizes, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
