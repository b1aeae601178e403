"""Language identification with language-bitmask n-gram filters.

One table holds a Bloom filter for every language, bit-sliced: slot s is a mask whose bit l belongs to language l. A
byte 5-gram looks up two slots; the AND of the masks has the bits of all languages that contain it. A text's
popcount for a language, less what that filter's false positives explain, is its share of known 5-grams there. A
filter holds every 5-gram that the labelled texts of its language have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, crc_mod, give_back, mix, text_chunks

GRAM = 5
SLOTS_A_GRAM, LEAST_BITS, MOST_BITS = 16, 16, 24  # the table's size by the largest filter
_CLEAN = LOWER.copy()  # ASCII other than letters becomes a space
_CLEAN[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all 5-grams of each text with a space at both ends, and each text's range of them."""
    n = np.diff(offs)
    doc = np.repeat(np.arange(len(n)), n)
    wide = np.full(len(buf) + 2 * len(n) + GRAM, 0x20, np.uint8)
    wide[np.arange(len(buf)) + 2 * doc + 1] = _CLEAN[buf]
    w = wide.astype(np.uint64)
    code = np.zeros(len(w) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        code |= w[k : k + len(code)] << np.uint64(8 * k)
    each = np.maximum(n + 2 - GRAM + 1, 0)
    at = np.concatenate([[0], np.cumsum(each)])
    return code[np.repeat(np.cumsum(n + 2) - n - 2 - at[:-1], each) + np.arange(at[-1])], at


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray  # (words, slots): bit l % 64 of word l // 64
    bits: int
    false_rate: np.ndarray

    @classmethod
    def of(cls, languages: list[str], slots: np.ndarray, words: np.ndarray, masks: np.ndarray, bits: int) -> LanguageFilters:
        """languages in the order of their bits; masks[k] are the bits of word words[k] in slot slots[k]."""
        table = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
        table[words, slots] = masks
        fill = np.array([float(((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))])
        return cls(languages, table.astype(np.uint8) if len(languages) <= 8 else table, bits, fill**2)

    @staticmethod
    def slots(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(code)
        return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    def shares(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, languages): part of a text's 5-grams that each language contains, corrected for false positives."""
        code, at = _grams(buf, offs)
        one, two = self.slots(code, self.bits)
        out = np.zeros((len(offs) - 1, len(self.languages)))
        n, some = np.diff(at), np.flatnonzero(np.diff(at) > 0)
        if not len(some):
            return out
        for word in range(len(self.table)):
            mask = self.table[word][one] & self.table[word][two]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                hit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                out[some, i] = np.add.reduceat(hit, at[:-1][some], dtype=np.int64)
        rate = out / np.maximum(n, 1)[:, None]
        return np.clip((rate - self.false_rate) / (1 - np.minimum(self.false_rate, 0.999)), 0, 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = np.array(b.column(0).to_pylist(), object)
        for row, buf, offs in text_chunks(b.column(1)):
            code, at = _grams(buf, offs)
            of = np.repeat(names[row : row + len(offs) - 1], np.diff(at))
            for name in set(of):
                g = np.unique(code[of == name])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64))], ["lang", "gram"])


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", key_column: str = "doc_id", sample: int = 3000) -> LanguageFilters:
    """Filters from labelled rows (text and lang not null).

    Of each language about `sample` documents are read whole, chosen by a hash of key and text, so that rows with a
    null or a repeated key are drawn apart; every 5-gram in them enters the language's filter. The filters are made by
    a grouping of slots: the driver gets the table of masks, never the grams. Languages are in descending order of
    their rows, then by name, which is also how ties are settled. Without labelled rows there is no language.
    """
    rows = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"), F.expr(f"pmod(xxhash64({key_column}, {text_column}, 11), 1000003) / 1000003.0D").alias("u"))
    sizes = rows.groupBy("lang").count()
    languages = [r["lang"] for r in sizes.orderBy(F.desc("count"), "lang").select("lang").collect()]  # a row for each language
    place = {name: i for i, name in enumerate(languages)}
    picked = rows.join(F.broadcast(sizes.select("lang", (F.lit(float(sample)) / F.col("count")).alias("part"))), "lang").where("u < part").select("lang", "text")
    grams = picked.mapInArrow(_count, "lang string, gram bigint").distinct()
    largest = grams.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    bits = int(np.clip(int(SLOTS_A_GRAM * largest - 1).bit_length(), LEAST_BITS, MOST_BITS))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            for slot in LanguageFilters.slots(b.column(1).to_numpy().view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(at // 64), pa.array((np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64))], ["slot", "word", "mask"])

    got = grams.mapInArrow(masks, "slot bigint, word bigint, mask bigint").groupBy("slot", "word").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()  # at most the table
    return LanguageFilters.of(languages, got["slot"].to_numpy(np.int64), got["word"].to_numpy(np.int64), got["mask"].to_numpy(np.int64).view(np.uint64), bits)


def predict(docs: DataFrame, model: LanguageFilters, text_column: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1: the winner's share of all languages' shares) and known (its share of known 5-grams).

    A null text, one without a letter, or no learned language at all: `und`, 0, 0. Ties go to the language with the most labelled rows, so a text
    of letters that no filter knows gets that one, with score 0. Null and repeated ids are rows like others.
    The columns lang_pred, score and known replace any of these names.
    """
    names = np.array([*model.languages, "und"], object)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "known")]
    docs = docs.select(*keep)
    at = keep.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(at)
            shares = np.zeros((b.num_rows, max(1, len(model.languages))))
            letter = np.zeros(b.num_rows, bool)
            for row, buf, offs in text_chunks(texts):
                if model.languages:
                    shares[row : row + len(offs) - 1] = model.shares(buf, offs)
                plain = np.concatenate([[0], np.cumsum((_CLEAN[buf] != 0x20) & (buf < 128))])
                letter[row : row + len(offs) - 1] = np.diff(plain[offs]) > 0
                for i in np.flatnonzero(~letter[row : row + len(offs) - 1]):
                    letter[row + i] = any(c.isalpha() for c in buf[offs[i] : offs[i + 1]].tobytes().decode())
            win = shares.argmax(1)
            known = shares[np.arange(len(win)), win]
            score = np.where(letter, known / np.maximum(shares.sum(1), 1e-12), 0.0)
            win = np.where(letter & bool(model.languages), win, len(model.languages))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[win], pa.string()), pa.array(np.where(win < len(model.languages), score, 0.0)), pa.array(np.where(letter, known, 0.0))], [*keep, "lang_pred", "score", "known"])
        give_back()

    schema = StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double").add("known", "double")
    return docs.mapInArrow(run, schema)


def language_of_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from rows whose crc32(doc_id) mod 3 is not 1."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "known")
