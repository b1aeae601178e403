"""Encoding of whole texts by a public tokenizer, a distinct text segment at a time.

A text is cut before spaces, around line ends and between letters and marks, where either pre-tokenizer cuts too, so the ids
of a text are those of its segments in a row. Each worker keeps the ids of the segments that it has met (up to
KEEP of them, then it starts anew), and the tokenizers library encodes the others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import CHUNK, mix, span_hashes, text_chunks

KEEP = 1_000_000
LEARN = 8192  # segments that the library encodes at once
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)  # a cut between an ASCII letter and a mark
_LETTER[65:91] = _LETTER[97:123] = True
MARKS = ",.!?;:|$%&*#"
_MARK[[ord(c) for c in MARKS]] = True
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # a byte-level vocabulary writes these bytes as themselves, others from U+0100 on
_WRITTEN = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
LATIN = "\u0250"  # letters before it are letters to every version of Unicode
_OPEN = np.zeros(256, bool)  # bytes that begin a character which is no white space, ASCII or U+00C0 to U+07FF
_OPEN[0x21:0x7F] = True
_OPEN[0xC3:0xE0] = True


class SegmentEncoder:
    """ids of many texts; `vocabulary` is a tokenizers JSON file."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # a run of ASCII letters, with or without a space before, is one pre-token: the model alone encodes it
        self.lower, self.space = self.tokenizer.normalizer is not None, "" if self.tokenizer.normalizer is not None else "\u0120"
        probe = [" Probe", "probe", " a", "Z", " hEaTh", "s", " t"]
        self.plain = [self._plain(x) for x in probe] == [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        # and marks behind it are a second one; so is a run of Latin letters, where bytes are written one by one
        self.tailed = self.plain and all(self._plain(a) + self._plain(b) == self.tokenizer.encode(a + b, add_special_tokens=False).ids for a in (" Probe", "s", " t") for b in (*MARKS, ".,", "?!;", "...", "&&#:"))
        latin = [f" a{chr(c)}b" for c in range(0x80, ord(LATIN)) if chr(c).isalpha()]
        self.latin = self.tailed and not self.lower and all(self._plain(x) == e.ids for x, e in zip(latin, self.tokenizer.encode_batch(latin, add_special_tokens=False), strict=True))
        self.tails: dict[str, list[int]] = {}
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def _plain(self, text: str) -> list[int]:
        text = text.replace(" ", self.space) if text.isascii() else text.encode().decode("latin-1").translate(_WRITTEN)
        return [t.id for t in self.tokenizer.model.tokenize(text.lower() if self.lower else text)]

    turn = 0  # counts how often it has forgotten

    def forget(self) -> None:
        self.turn += 1
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, entry of each
        self.flat, self.size = np.zeros(1 << 16, self.kind), 0
        self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, texts: list[str], letters: np.ndarray) -> None:
        got: list[list[int]] = [[]] * len(texts)
        simple = letters & self.plain
        model, space, lower = self.tokenizer.model, self.space, self.lower
        for i in np.flatnonzero(simple).tolist():
            text = texts[i].replace(" ", space)
            got[i] = [t.id for t in model.tokenize(text.lower() if lower else text)]
        rest = np.flatnonzero(~simple).tolist()
        if self.tailed:
            stems: dict[str, list[int]] = {}
            other = []
            for i in rest:
                stem = texts[i].rstrip(MARKS)
                if not (stem.removeprefix(" ").isalpha() and (stem.isascii() or self.latin and max(stem) < LATIN)):
                    other.append(i)
                    continue
                tail = texts[i][len(stem) :]
                if stem not in stems:
                    stems[stem] = self._plain(stem)
                if tail not in self.tails:
                    if len(self.tails) >= LEARN:
                        self.tails.clear()
                    self.tails[tail] = self._plain(tail)
                got[i] = stems[stem] + self.tails[tail]
            rest = other
        for k in range(0, len(rest), LEARN):
            part = rest[k : k + LEARN]
            for i, e in zip(part, self.tokenizer.encode_batch([texts[i] for i in part], add_special_tokens=False), strict=True):
                got[i] = e.ids
        count = np.array([len(x) for x in got], np.int64)
        new = np.fromiter(chain.from_iterable(got), self.kind, int(count.sum()))
        while self.size + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.size : self.size + len(new)] = new
        first = len(self.at)
        self.at = np.concatenate([self.at, (self.size + np.cumsum(count) - count).astype(np.int32)])
        self.len = np.concatenate([self.len, count.astype(np.int32)])
        self.size += len(new)
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.rows = np.insert(self.keys, place, keys[order]), np.insert(self.rows, place, (first + order).astype(np.int32))

    def entries(self, keys: np.ndarray, code: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: str = "") -> np.ndarray:
        """The entry of each distinct hash; keys[code] are the hashes of the spans. `before` is put before a span that is new and is part of its key, so that a bare span never finds the ids of one with a prefix."""
        if before:
            keys = mix(keys ^ np.uint64(int.from_bytes(before.encode()[:8], "little") * 0x9E3779B97F4A7C15 % (1 << 64)))
        spot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[spot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + len(keys) > KEEP:
                self.forget()
                known = np.zeros(len(keys), bool)
            first = np.zeros(len(keys), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            raw, first = buf.tobytes(), first[~known]
            other = np.concatenate([[0], np.cumsum(~_LETTER[buf])])
            a, b = starts[first], ends[first]
            a = a + ((buf[a] == 0x20) & (b - a > 1))
            self._learn(keys[~known], [before + raw[starts[i] : ends[i]].decode() for i in first.tolist()], other[b] == other[a])
            spot = np.searchsorted(self.keys, keys)
        return self.rows[spot]

    def __call__(self, column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of rows (uint16, or uint32 for a vocabulary over 65,536), offsets of the rows in them)."""
        for row, buf, offs in text_chunks(column, limit):
            n = len(buf)
            if not n:
                yield row, np.zeros(0, self.kind), np.zeros(len(offs), np.int64)
                continue
            cut = np.zeros(n + 1, bool)
            opens = np.append(_OPEN[buf[1:]], False)
            cut[:n] |= (buf == 0x20) & opens
            line = (buf == 0x0A) & opens & np.concatenate([[False], (buf[:-1] > 0x20) & (buf[:-1] < 0x7F)])
            cut[:n] |= line
            cut[1:] |= line
            cut[1:n] |= _MARK[buf[1:]] & _LETTER[buf[:-1]]
            cut[offs] = True
            edges = np.flatnonzero(cut)
            starts, ends = edges[:-1], edges[1:]
            h = span_hashes(buf, starts, ends)
            code, keys = pd.factorize(h)
            entry = self.entries(keys, code, buf, starts, ends)[code]
            length = self.len[entry].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(length)])
            ids = self.flat[np.repeat(self.at[entry] - total[:-1], length) + np.arange(total[-1])]
            yield row, ids, total[np.searchsorted(starts, offs)]


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(vocabulary: str) -> SegmentEncoder:
    """The worker's own encoder: workers are reused, and so is what they have met."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = SegmentEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def release() -> None:
    """Forget the worker's encoders."""
    _ENCODERS.clear()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
