"""Substring deduplication by paragraph MinHash banding.

A paragraph is a sentence of a line (a cut follows a line end, or `.`, `!` or `?` with a space), so that a passage that
was set into another text falls into the same paragraphs there. Paragraphs have their five-word shingles MinHashed and
banded (bands() tunes them for the wanted recall); one of fewer words is a single shingle, and has one key. Paragraphs
that collide in a band are verified by exact Jaccard, verified links are closed into components, and of each component
that occurs in several documents the occurrences outside the smallest doc_id are repeats. Repeats with nothing but shorter
paragraphs between them are a run. A passage that was set into the middle of sentences begins and ends in paragraphs that
are glued to it, so a run grows word by word into the paragraph before and after it, as far as these agree with their
like in the document that it repeats. Runs of RUN_WORDS words or more are removed. A repeat of fewer than five words
counts only beside a repeat of the same earlier document: short lines are met anywhere, verses are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, give_back, mix, shingles, span_hashes, stash, text_chunks, word_spans
from .graph import components, union_find

SIZE, RUN_WORDS, PART = 5, 25, 2000
LEAST_BITS, MOST_BITS = 23, 27  # of a filter: eight for each item, and no more than 16 MB


def bands(percent: int, recall: float, most_rows: int = 4, unlike: float = 0.3, pair_cost: float = 15.0) -> tuple[int, int]:
    """(bands, rows): the cheapest of the tunings whose recall at this similarity reaches `recall`.

    Each number of rows up to `most_rows` needs its own fewest bands. A tuning costs a key for each band, and
    `pair_cost` keys times the chance that a pair of the low similarity `unlike` collides and has to be verified.
    """
    best = []
    for rows in range(1, most_rows + 1):
        n = 1
        while 1 - (1 - (percent / 100) ** rows) ** n < recall:
            n += 1
        best.append((n + pair_cost * (1 - (1 - unlike**rows) ** n), n, rows))
    return min(best)[1:]


class Units:
    """The paragraphs of a run of texts: byte starts and ends, words, range of each text, and the shingles of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = LOWER[buf]
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        line = np.flatnonzero(buf == 0x0A)
        cut[line + 1] = True
        stop = (buf == 0x2E) | (buf == 0x21) | (buf == 0x3F)
        cut[np.flatnonzero(stop[:-1] & (buf[1:] == 0x20)) + 2] = True
        edges = np.flatnonzero(cut)
        self.starts, self.ends = (edges[:-1], edges[1:]) if n else (edges[:0], edges[:0])
        self.first = np.searchsorted(self.starts, offs) if n else np.zeros(len(offs), np.int64)
        self.word_starts, self.word_ends, self.word_at = word_spans(low, np.append(self.starts, n))  # of each word, and each paragraph's range of words
        self.words = np.diff(self.word_at) if n else np.zeros(0, np.int64)
        self.word = span_hashes(low, self.word_starts, self.word_ends) if n else np.zeros(0, np.uint64)
        self.shingles, self.at = shingles(self.word, self.word_at, SIZE) if n else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.long = np.flatnonzero(self.words > 0)
        self.key = np.zeros(len(self.starts), np.uint64)  # stands for the words in their order
        if len(self.long):
            place = np.arange(len(self.shingles), dtype=np.uint64) - np.repeat(self.at[:-1], np.diff(self.at)).astype(np.uint64)
            self.key[self.long] = mix(np.add.reduceat(mix(self.shingles + place * np.uint64(0x9E3779B97F4A7C15)), self.at[:-1])[self.long])

    def minima(self, k: int) -> np.ndarray:
        """The k-th MinHash of each paragraph in `long`."""
        return np.minimum.reduceat(mix(self.shingles ^ np.uint64(0xA24BAED4963EE407 * (2 * k + 1) % (1 << 64))), self.at[:-1])[self.long]

    def words_of(self, i: int) -> np.ndarray:
        """32 bits of each word of a paragraph, in order."""
        return (self.word[self.word_at[i] : self.word_at[i + 1]] >> np.uint64(32)).astype(np.uint32)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _signed(u: np.ndarray) -> np.ndarray:
    return u.view(np.int64)


def _keys(n_bands: int, rows: int, heavy: frozenset[int] = frozenset()):
    hot_keys = np.array(sorted(heavy), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in text_chunks(b.column(1)):
                u = Units(buf, offs)
                if not len(u.long):
                    continue
                who = b.column(0).to_numpy(zero_copy_only=False)[row + u.doc()[u.long]]
                units, many = _signed(u.key[u.long]), u.words[u.long] > SIZE  # with one shingle, equal in one band is equal in all
                for k in range(n_bands):
                    key = mix(sum((mix(u.minima(k * rows + r) + np.uint64(r)) for r in range(rows)), np.zeros(len(u.long), np.uint64)) + np.uint64(k))
                    some = many if k else slice(None)
                    key = _signed(key)[some]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(units[some]), pa.array(who[some].astype(np.int64)), pa.array(np.isin(key, hot_keys))], ["key", "unit", "id", "hot"])

    return run


def _verify(percent: int):
    """Links (unit, unit) among the paragraphs of a block; those already linked in the block aren't compared again."""

    def run(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"].combine_chunks()]
        unit, chunk = t["unit"].to_numpy(), t["chunk"].to_numpy()
        c1, c2 = t["c1"][0].as_py(), t["c2"][0].as_py()
        n = np.array([len(s) for s in sets])
        at, flat = np.concatenate([[0], np.cumsum(n)]), np.concatenate(sets)
        group = np.arange(len(sets))
        a, b = [], []
        for i in range(len(sets)):
            if (group[i + 1 :] == group[i]).all():
                continue
            both = np.add.reduceat(np.isin(flat[at[i + 1] :], sets[i]), at[i + 1 : -1] - at[i + 1], dtype=np.int64)
            ok = (100 * both >= percent * (n[i] + n[i + 1 :] - both)) & (group[i + 1 :] != group[i])
            if c1 != c2:
                ok &= chunk[i + 1 :] != chunk[i]
            j = i + 1 + np.flatnonzero(ok)
            if len(j):
                a += [i] * len(j)
                b += j.tolist()
                hit = np.isin(group, group[j])
                group[hit | (group == group[i])] = group[i]
        return pa.table({"a": pa.array(unit[a], pa.int64()), "b": pa.array(unit[b], pa.int64())})

    return run


def _bit_filter(needed: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """(bit array over the low bits of an integer column of distinct rows, number of those bits); false hits are joined away later."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(8 * needed.count() + 1)))))
    words = needed.select(F.expr(f"{column} & {(1 << bits) - 1}L").alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("v")).toArrow()  # at most 2^(MOST_BITS - 6) rows
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["v"].to_numpy()
    return table.view(np.uint8), bits


def _has(packed: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    low = values & np.uint64((1 << bits) - 1)
    return (packed[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _beside(ids: tuple[np.ndarray, int], units: tuple[np.ndarray, int]):
    """(first_id, first_unit, before, after): words of the paragraphs before and after those that `units` may hold, in documents that `ids` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_has(*ids, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))))
            for row, buf, offs in text_chunks(b.column(1)):
                u = Units(buf, offs)
                doc = u.doc()
                hit = u.long[_has(*units, u.key[u.long])]
                if not len(hit):
                    continue
                begin, end = u.first[doc[hit]], u.first[doc[hit] + 1] - 1
                before = [u.words_of(i - 1).tobytes() if i > x else b"" for i, x in zip(hit.tolist(), begin.tolist(), strict=True)]
                after = [u.words_of(i + 1).tobytes() if i < y else b"" for i, y in zip(hit.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + doc[hit])), pa.array(_signed(u.key[hit])), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["first_id", "first_unit", "before", "after"])
        give_back()

    return run


def _sets(packed: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            for _, buf, offs in text_chunks(b.column(0)):
                u = Units(buf, offs)
                want = u.long[_has(packed, bits, u.key[u.long])]
                key = _signed(u.key)
                new = [i for i in want.tolist() if key[i] not in met and not met.add(key[i])]
                if len(met) > 500_000:
                    met.clear()
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array([np.unique(u.shingles[u.at[i] : u.at[i + 1]]).tobytes() for i in new], pa.binary())], ["unit", "shingles"])

    return run


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75, recall: float = 0.98) -> DataFrame:
    """(id, unit, first_id, first_unit): paragraphs of a document that repeat the paragraph first_unit of the document first_id < id."""
    docs = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    n_bands, rows = bands(percent, recall)
    schema = "key bigint, unit bigint, id bigint, hot boolean"
    # keys of a few thousandths of the documents, found on a sample of them, skip the test for company and are salted;
    # they are at most 500 times as many as a document has on average
    some = docs.where("pmod(xxhash64(id, 23), 50) = 0").mapInArrow(_keys(n_bands, rows), schema)
    limit = max(20, docs.select("id").count() // 50 // 500)
    heavy = frozenset(r["key"] for r in some.groupBy("key").agg(F.approx_count_distinct("id").alias("n")).where(F.col("n") >= limit).select("key").collect())
    found = docs.mapInArrow(_keys(n_bands, rows, heavy), schema).withColumn("salt", F.expr("if(hot, pmod(xxhash64(unit, id), 64), 0)"))
    window = "over (partition by key, salt)"
    company = F.expr(f"min(struct(unit, id)) {window} <> max(struct(unit, id)) {window}")
    shared = stash(found.withColumn("company", company).where("hot or company").select("key", "unit", "id").distinct())

    # different paragraphs of one key: exact Jaccard inside blocks
    pairs = shared.select("key", "unit").distinct()
    blocks = pairs.groupBy("key").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(unit))").alias("x")).where("m > 1").groupBy("m", "x").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / PART).alias("k"))
    members = stash(pairs.join(blocks, "key"))
    needed = members.select("unit").distinct()
    sets = docs.select("text").mapInArrow(_sets(*_bit_filter(needed, "unit")), "unit bigint, shingles binary").groupBy("unit").agg(F.first("shingles").alias("shingles"))
    dealt = members.join(sets, "unit").withColumn("chunk", F.expr("int(pmod(xxhash64(unit, 7), k))")).withColumn("other", F.explode(F.expr("sequence(0, int(k) - 1)")))
    dealt = dealt.selectExpr("key", "least(chunk, other) c1", "greatest(chunk, other) c2", "chunk", "unit", "shingles")
    links = stash(dealt.groupBy("key", "c1", "c2").applyInArrow(_verify(percent), "a bigint, b bigint").distinct())
    named = components(links)

    occurs = shared.select("unit", "id").distinct().join(named.selectExpr("node unit", "component"), "unit", "left").withColumn("class", F.coalesce("component", "unit"))
    occurs = stash(occurs.select("class", "unit", "id"))
    first = stash(occurs.groupBy("class").agg(F.min(F.struct("id", "unit")).alias("f"), F.max("id").alias("last_id"), F.count("*").alias("n")).select("class", F.col("f.id").alias("first_id"), F.col("f.unit").alias("first_unit"), "last_id", "n").where("first_id <> last_id"))
    # a class of a ten-thousandth of all occurrences or more (there are at most ten thousand) goes to them; the others meet by hash
    most = max(1000, (first.agg(F.sum("n")).first()[0] or 0) // 10_000)
    hot, cold = F.broadcast(first.where(F.col("n") >= most).select("class", "first_id", "first_unit")), first.where(F.col("n") < most).select("class", "first_id", "first_unit")
    large = occurs.join(hot, "class").select("id", "unit", "first_id", "first_unit")
    small = occurs.join(hot, "class", "left_anti").join(cold, "class").select("id", "unit", "first_id", "first_unit")
    out = stash(large.union(small).where("id <> first_id"))
    discard(occurs, first)
    discard(shared, members, links, named)
    return out


def _agreeing(own: np.ndarray, other: np.ndarray) -> int:
    """How many words two lists have in common from their first word on."""
    n = min(len(own), len(other))
    differs = np.flatnonzero(own[:n] != other[:n])
    return int(differs[0]) if len(differs) else n


def _runs(key: list[int], words: list[int], source: dict[int, int], run_words: int, grown=lambda k, stop: (0, 0)) -> Iterator[tuple[int, int, set[int], int, int]]:
    """(first unit, last unit, earlier documents, words before, words after) of each run of repeats with run_words words or more in a document's units.

    grown(first, last) tells how many words before and after the units belong to the run as well.

    A run goes on over repeats and over units of fewer than SIZE words. It begins and ends with a repeat that counts:
    one of SIZE words or more, or a shorter one whose nearest repeat before or after it has the same earlier document.
    """
    last = len(key)
    at = [k for k in range(last) if words[k] and key[k] in source]
    near = {}
    for i, k in enumerate(at):
        beside = [source[key[j]] for j in at[max(0, i - 1) : i] + at[i + 1 : i + 2] if all(words[x] < SIZE or key[x] in source for x in range(min(j, k), max(j, k)))]
        near[k] = words[k] >= SIZE or source[key[k]] in beside
    k = 0
    while k < last:
        if not near.get(k):
            k += 1
            continue
        total, stop, j, met = 0, k, k, set()
        while j < last and (words[j] < SIZE or j in near):
            if near.get(j):
                total, stop = total + words[j], j
                met.add(source[key[j]])
            j += 1
        left, right = grown(k, stop)
        if total + left + right >= run_words:
            yield k, stop, met, left, right
        k = j


def _remove(at_id: int, at_text: int, run_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, of, kept = [], [], []
            units, firsts, befores, afters = (b.column(b.num_columns - k) for k in (4, 3, 2, 1))
            for row, buf, offs in text_chunks(b.column(at_text)):
                u, raw = Units(buf, offs), buf.tobytes()
                keys, words = _signed(u.key), u.words
                for i in range(len(offs) - 1):
                    begin, end = int(offs[i]), int(offs[i + 1])
                    marked, cuts, sources = units[row + i].as_py(), [], set()
                    if marked:
                        source = dict(zip(marked, firsts[row + i].as_py(), strict=True))
                        beside = {k: (np.frombuffer(x or b"", np.uint32), np.frombuffer(y or b"", np.uint32)) for k, x, y in zip(marked, befores[row + i].as_py(), afters[row + i].as_py(), strict=True)}
                        lo, hi = int(u.first[i]), int(u.first[i + 1])

                        def grown(k: int, stop: int, lo: int = lo, hi: int = hi, beside: dict = beside, u: Units = u, keys: np.ndarray = keys) -> tuple[int, int]:
                            left = _agreeing(u.words_of(lo + k - 1)[::-1], beside[int(keys[lo + k])][0][::-1]) if k else 0
                            return left, _agreeing(u.words_of(lo + stop + 1), beside[int(keys[lo + stop])][1]) if lo + stop + 1 < hi else 0

                        spot = begin
                        for x, y, met, left, right in _runs(keys[lo:hi].tolist(), words[lo:hi].tolist(), source, run_words, grown):
                            first = int(u.word_starts[u.word_at[lo + x] - left]) if left else int(u.starts[lo + x])
                            last = int(u.word_ends[u.word_at[lo + y + 1] + right - 1]) if right else int(u.ends[lo + y])
                            first = max(first, spot)  # two runs may grow into one paragraph between them
                            if last > first:
                                cuts.append((first, last))
                                spot = last
                            sources |= met
                    text, spot = [], begin
                    for x, y in cuts:
                        text.append(raw[spot:x])
                        spot = y
                    text.append(raw[spot:end])
                    kept.append(b"".join(text).decode() if cuts else (None if b.column(at_text)[row + i].as_py() is None else raw[begin:end].decode()))
                    chars = lambda x, y=begin: len(raw[y:x].decode())
                    spans.append([{"start": chars(x), "stop": chars(y)} for x, y in cuts])
                    of.append(sorted(sources))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[: b.num_columns - 4], pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(of, pa.list_(pa.int64())), pa.array(kept, pa.string())], [*b.schema.names[:-4], "removed", "repeats_of", "kept_text"])
        give_back()

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with removed (spans in code points, end exclusive), repeats_of (documents that hold them) and kept_text.

    A row for each row. Null texts stay null, rows with a null id are left alone, and rows that share an id lose the
    paragraphs that repeat another id's. Columns of these three names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("removed", "repeats_of", "kept_text")]
    docs = docs.select(*keep)
    found = repeats(docs, id_column, text_column, percent)
    sources = stash(found.groupBy("first_id", "first_unit").agg(F.count("*").alias("n")))
    texts = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    filters = _bit_filter(sources.select("first_id").distinct(), "first_id"), _bit_filter(sources.select("first_unit").distinct(), "first_unit")
    beside = texts.mapInArrow(_beside(*filters), "first_id bigint, first_unit bigint, before binary, after binary")
    beside = stash(beside.join(sources, ["first_id", "first_unit"]).groupBy("first_id", "first_unit").agg(F.first("n").alias("n"), F.max("before").alias("before"), F.max("after").alias("after")))
    most = max(1000, (sources.agg(F.sum("n")).first()[0] or 0) // 10_000)  # a paragraph that so many repeat goes to them: at most ten thousand
    hot, cold = F.broadcast(beside.where(F.col("n") >= most).drop("n")), beside.where(F.col("n") < most).drop("n")
    known = found.join(hot, ["first_id", "first_unit"]).unionByName(found.join(hot, ["first_id", "first_unit"], "left_anti").join(cold, ["first_id", "first_unit"], "left"), allowMissingColumns=True)
    marks = known.groupBy("id").agg(F.collect_list(F.struct("unit", "first_id", "before", "after")).alias("m"))
    marks = marks.select(F.col("id").alias("_mark_id"), F.col("m.unit").alias("_units"), F.col("m.first_id").alias("_firsts"), F.col("m.before").alias("_befores"), F.col("m.after").alias("_afters"))
    both = docs.join(marks, docs[id_column] == marks["_mark_id"], "left").drop("_mark_id")
    from pyspark.sql.types import ArrayType, LongType, StringType, StructType

    schema = StructType(list(docs.schema)).add("removed", ArrayType(StructType().add("start", LongType()).add("stop", LongType()))).add("repeats_of", ArrayType(LongType())).add("kept_text", StringType())
    return both.mapInArrow(_remove(keep.index(id_column), keep.index(text_column), run_words), schema)


def substrings_of_all(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (spans), removed_chars, kept_chars, removed and repeats_of (doc_ids) of every document that loses a passage; the document that keeps it is named in repeats_of."""
    out = remove_repeats(docs.select("doc_id", "text")).where(F.size("removed") > 0)
    chars = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), chars.alias("removed_chars"), F.char_length("kept_text").cast("bigint").alias("kept_chars"), "removed", "repeats_of")
