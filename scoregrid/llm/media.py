"""Media columns: AVI files of motion-JPEG frames.

write_avi() makes an AVI of grey baseline-JPEG frames, read_avi() parses RIFF chunks, the stream headers and the idx1
index, decode_jpeg() decodes an intra frame, and shots() cuts a run of frames where the histogram of a frame differs
from its predecessor's by more than the running mean and deviation of the shot allow.

A payload byte b is stored as a quantised coefficient, the format's own integer: 8 bits after a Huffman code of size
category 8, that is b for b > 127 and b - 255 below. 64 bytes fill a block, so a file holds any payload without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

SIDE, FPS = 64, 25  # pixels of a frame's side; a frame has (SIDE / 8)^2 blocks
BLOCKS = (SIDE // 8) ** 2
# Fixed values of the JPEG format: the zigzag order of coefficients, row by row.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_K = np.arange(8)
COSINE = (np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


# one-symbol Huffman tables (code 0 for category 8), a quantiser of ones, and a restart after each block, so that the
# DC prediction starts from 0 in every block
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + _segment(0xC4, bytes([0, 1]) + bytes(15) + b"\x08") + _segment(0xC4, bytes([0x10, 1]) + bytes(15) + b"\x08") + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG frames of a payload whose size is a multiple of 64; the last frame's missing blocks hold 0 bytes."""
    full = np.zeros(-(-len(payload) // (64 * BLOCKS)) * 64 * BLOCKS, np.uint8)
    full[: len(payload)] = payload
    bits = np.zeros((len(full) // 64, 64, 9), np.uint8)  # a 0 bit is the code, then the byte
    bits[:, :, 1:] = np.unpackbits(full).reshape(-1, 64, 8)
    packed = np.packbits(bits.reshape(len(bits), -1), axis=1)  # 72 bytes a block
    restart = np.arange(len(packed)) % BLOCKS
    raw = np.empty((len(packed), 74), np.uint8)
    raw[:, :72], raw[:, 72], raw[:, 73] = packed, 0xFF, 0xD0 + restart % 8
    flat = raw.reshape(-1)
    stuffed = (flat == 0xFF) & (np.arange(len(flat)) % 74 != 72)
    keep = np.ones(len(flat), bool)
    keep[BLOCKS * 74 - 2 :: BLOCKS * 74] = keep[BLOCKS * 74 - 1 :: BLOCKS * 74] = False  # no restart after the last block
    place = np.cumsum(stuffed + keep) - (stuffed + keep)
    out = np.zeros(int(place[-1] + stuffed[-1] + keep[-1]), np.uint8)
    out[place[keep]] = flat[keep]
    ends = np.append(place[:: BLOCKS * 74], len(out))
    body = out.tobytes()
    return [_HEAD + body[a:b] + b"\xff\xd9" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: np.ndarray) -> bytes:
    """An AVI file; its INFO list says how many payload bytes it holds."""
    frames = encode_frames(payload)
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    shape = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", shape)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        movie.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    fps: float
    frames: list[bytes]
    payload: int | None


def read_avi(raw: bytes) -> Avi:
    """Frames of the first video stream, in index order (without idx1: in file order)."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found = {"fps": 25.0, "movi": 0, "index": None, "payload": None, "frames": []}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
            body = at + 8
            if name in (b"LIST", b"RIFF"):
                if raw[body : body + 4] == b"movi":
                    found["movi"] = body
                walk(body + 4, min(end, body + size))
            elif name == b"strh" and raw[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", raw, body + 20)
                found["fps"] = rate / scale if scale else 25.0
            elif name == b"idx1":
                found["index"] = (body, size // 16)
            elif name == b"ICMT" and raw[body : body + 8] == b"payload=":
                found["payload"] = int(raw[body + 8 : body + size].rstrip(b"\0"))
            elif name[2:] in (b"dc", b"db"):
                found["frames"].append((body, size))
            at = body + size + size % 2

    walk(0, len(raw))
    spots = found["frames"]
    if found["index"]:
        body, n = found["index"]
        rows = [struct.unpack_from("<4sIII", raw, body + 16 * i) for i in range(n)]
        rows = [(o, s) for name, _, o, s in rows if name[2:] in (b"dc", b"db")]
        base = found["movi"] if not rows or rows[0][0] < found["movi"] else 0  # offsets count from movi or from the file
        spots = [(base + o + 8, s) for o, s in rows]
    return Avi(found["fps"], [raw[a : a + s] for a, s in spots], found["payload"])


def _tables(lengths: np.ndarray, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit look-ahead: the symbol and the code length (0: no code)."""
    symbol, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for n in range(1, 17):
        for _ in range(int(lengths[n - 1])):
            a = code << (16 - n)
            symbol[a : a + (1 << (16 - n))], size[a : a + (1 << (16 - n))] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, size


def decode_coefficients(frame: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(blocks, 64) quantised coefficients in zigzag order, the quantiser, width and height of a grey baseline JPEG.

    All restart intervals are decoded side by side, one coefficient of each at a time. Where both Huffman tables hold
    one symbol of equal size, as in our own files, every coefficient has the same width and the bits are cut in one step.
    """
    at, quant, tables, restart, shape = 2, np.ones(64, np.int64), {}, 0, None
    while True:
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, end = at + 4, at + 2 + size
        if mark == 0xDB:
            while body < end:
                wide = frame[body] >> 4
                quant = np.frombuffer(frame, ">u2" if wide else np.uint8, 64, body + 1).astype(np.int64)
                body += 1 + 64 * (1 + wide)
        elif mark == 0xC0:
            _, high, wide, parts = struct.unpack_from(">BHHB", frame, body)
            if parts != 1:
                raise ValueError("only grey frames are decoded")
            shape = (wide, high)
        elif mark == 0xC4:
            while body < end:
                lengths = np.frombuffer(frame, np.uint8, 16, body + 1)
                n = int(lengths.sum())
                tables[frame[body]] = (lengths, frame[body + 17 : body + 17 + n])
                body += 17 + n
        elif mark == 0xDD:
            restart = struct.unpack_from(">H", frame, body)[0]
        elif 0xC1 <= mark <= 0xCF:
            raise ValueError("only baseline frames are decoded")
        at = end
        if mark == 0xDA:
            break
    wide, high = shape
    blocks = -(-wide // 8) * -(-high // 8)
    data = np.frombuffer(frame, np.uint8, len(frame) - at, at)
    after = np.append(data[1:], 0)
    marks = np.flatnonzero((data == 0xFF) & (after != 0))
    cuts = [m for m in marks.tolist() if 0xD0 <= after[m] <= 0xD7]
    stop = next((m for m in marks.tolist() if after[m] == 0xD9), len(data))
    starts, ends = np.array([0, *[m + 2 for m in cuts]]), np.array([*cuts, stop])
    drop = np.zeros(len(data), bool)
    drop[1:] = (data[:-1] == 0xFF) & (data[1:] == 0)
    kept = np.concatenate([[0], np.cumsum(~drop)])
    clean = data[~drop]
    first, size = kept[starts], kept[ends] - kept[starts]
    per = restart or blocks
    own = np.minimum(per, blocks - per * np.arange(len(starts)))
    (dc_n, dc_s), (ac_n, ac_s) = tables[0x00], tables[0x10]
    if len(dc_s) == len(ac_s) == 1 and dc_s == ac_s and dc_s[0] in range(1, 12) and per == 1 and dc_n[0] == ac_n[0] == 1:
        width = 1 + dc_s[0]
        need = 8 * width  # bytes of a block: 64 * width bits
        bits = np.unpackbits(clean[first[:, None] + np.arange(need)], axis=1).reshape(len(starts), 64, width)[:, :, 1:]
        value = bits.astype(np.int64) @ (1 << np.arange(width - 2, -1, -1))
        return np.where(value >> (width - 2) & 1, value, value - (1 << (width - 1)) + 1), quant, wide, high
    dc_t, ac_t = _tables(dc_n, dc_s), _tables(ac_n, ac_s)
    padded = np.append(clean, np.zeros(8, np.uint8)).astype(np.uint64)
    out, spot = np.zeros((blocks, 64), np.int64), first * 8

    def peek(bit: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(bit >> 3, len(clean))
        word = np.zeros(len(bit), np.uint64)
        for k in range(4):
            word = word << np.uint64(8) | padded[at + k]
        return (word >> (np.uint64(32 - n) - (bit & 7).astype(np.uint64))).astype(np.int64) & ((1 << n) - 1)

    def number(bit: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = peek(bit, 16) >> (16 - n)
        return np.where(n == 0, 0, np.where(v >> np.maximum(n - 1, 0) & 1, v, v - (1 << n) + 1))

    last = np.zeros(len(starts), np.int64)
    for b in range(per):
        live = np.flatnonzero(b < own)
        look = peek(spot[live], 16)
        n = dc_t[0][look]
        spot[live] += dc_t[1][look]
        last[live] += number(spot[live], n)
        spot[live] += n
        row = live * per + b
        out[row, 0] = last[live]
        k = np.ones(len(live), np.int64)
        while len(live):
            look = peek(spot[live], 16)
            symbol = ac_t[0][look]
            spot[live] += ac_t[1][look]
            run, n = symbol >> 4, symbol & 15
            k = k + run
            put = (n > 0) & (k < 64)
            out[row[put], k[put]] = number(spot[live], n)[put]
            spot[live] += n
            go = (k < 63) & ((n > 0) | (run == 15))
            live, row, k = live[go], row[go], k[go] + 1
    return out, quant, wide, high


def pixels(coefficients: np.ndarray, quant: np.ndarray, wide: int, high: int) -> np.ndarray:
    """Grey pixels by the inverse cosine transform."""
    square = np.zeros((len(coefficients), 64), np.float32)
    square[:, ZIGZAG] = coefficients * quant
    x = COSINE @ square.reshape(-1, 8, 8) @ COSINE.T + 128
    across = -(-wide // 8)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8).reshape(-1, across, 8, 8).swapaxes(1, 2).reshape(-1, across * 8)[:high, :wide]


def decode_jpeg(frame: bytes) -> np.ndarray:
    """(height, width) grey pixels of an intra frame."""
    return pixels(*decode_coefficients(frame))


def shots(frames: list[np.ndarray], bins: int = 32, factor: float = 3.0, least: float = 0.1, first: float = 0.5) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot: a cut stands where a histogram differs from its predecessor's
    by more than the mean of the shot's differences so far, plus `factor` deviations, plus `least`; a shot's first
    difference has none before it and cuts beyond `first`."""
    hist = [np.bincount(f.ravel() >> 3, minlength=bins) / f.size for f in frames]
    cuts, seen = [0], []
    for i in range(1, len(hist)):
        d = float(np.abs(hist[i] - hist[i - 1]).sum()) / 2
        if d > (np.mean(seen) + factor * np.std(seen) + least if seen else first):
            cuts.append(i)
            seen = []
        else:
            seen.append(d)
    return list(zip(cuts, [*cuts[1:], len(hist)], strict=True)) if hist else []


CLIPS = "media_id bigint, clip int, first_frame int, frames int, start_s double, end_s double"


def clips(media: DataFrame, id_column: str = "media_id", media_column: str = "media") -> DataFrame:
    """Timed clip rows of each AVI file: (media_id, clip, first_frame, frames, start_s, end_s). Null or empty files give none; a damaged file, or one whose frames the decoder refuses (colour), gives one row of nulls beside its id, so that it can be told from one without frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if raw.as_py():
                    try:
                        avi = read_avi(raw.as_py())
                        cuts = shots([decode_jpeg(f) for f in avi.frames])
                    except (ValueError, IndexError, KeyError, struct.error):
                        rows.append((name, *[None] * 5))
                        continue
                    rows += [(name, k, x, y - x, x / avi.fps, y / avi.fps) for k, (x, y) in enumerate(cuts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows, strict=True)], ["media_id", "clip", "first_frame", "frames", "start_s", "end_s"]).cast(pa.schema([("media_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    return media.select(F.col(id_column).cast("bigint"), F.col(media_column)).mapInArrow(run, CLIPS)


def read_back(raw: bytes) -> tuple[bytes, list[tuple[int, int]], float]:
    """Payload, shots and frame rate of one of our own files."""
    avi = read_avi(raw)
    coded = [decode_coefficients(f) for f in avi.frames]
    flat = np.concatenate([c[0] for c in coded])
    payload = np.where(flat > 0, flat, flat + 255).astype(np.uint8).ravel()[: avi.payload]
    return payload.tobytes(), shots([pixels(*c) for c in coded]), avi.fps


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text as an AVI file, read back: sizes, hashes and the clips that its frames fall into.

    Null and empty texts are a payload of 64 zero bytes. Null and repeated ids are rows like others. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in text_chunks(b.column(1)):
                out = []
                for i in range(len(offs) - 1):
                    own = buf[offs[i] : offs[i + 1]]
                    padded = np.zeros(max(64, -(-len(own) // 64) * 64), np.uint8)
                    padded[: len(own)] = own
                    media = write_avi(padded)
                    payload, cuts, fps = read_back(media)
                    feature = f"fps={fps:g};frames={cuts[-1][1]};shots={len(cuts)};clips=" + ",".join(f"{a / fps:.2f}-{z / fps:.2f}" for a, z in cuts)
                    out.append((len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                cols = [pa.array(list(x)) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(out)), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_column).mapInArrow(run, DIGEST)
