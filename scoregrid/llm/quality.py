"""Quality classifier: a convolutional network over bytes, in numpy.

A text is cut into chunks of CHUNK bytes, SHIFT apart, that cover all of it. Bytes are embedded, learned filters slide
over each chunk, their rectified outputs are max-pooled in the chunk, and a small dense layer turns the pooled vector
into the chunk's log-odds. The mean over all chunks, squashed, is the text's probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_mod, text_chunks

CHUNK, SHIFT, WIDTH, STEP, EMBED, FILTERS, HIDDEN = 128, 96, 6, 2, 6, 20, 12
SPOTS = (CHUNK - WIDTH) // STEP + 1


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            if g.dtype != self.m[k].dtype:
                self.m[k], self.v[k] = (np.asarray(z, np.result_type(z, g)) for z in (self.m[k], self.v[k]))
            m, v, x = self.m[k], self.v[k], 0.1 * g  # in place: the same operations, without an array for each
            m *= 0.9
            m += x
            np.multiply(g, 0.001, out=x)
            x *= g
            v *= 0.999
            v += x
            np.divide(v, 1 - 0.999**self.t, out=x)
            np.sqrt(x, out=x)
            x += 1e-8
            y = self.rate * m
            y /= 1 - 0.9**self.t
            y /= x
            params[k] -= y.astype(np.float32, copy=False)


def _windows(chunks: np.ndarray) -> np.ndarray:
    """(chunks, SPOTS, WIDTH) bytes under each place of a filter."""
    return np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[:, ::STEP]


def _forward(p: dict[str, np.ndarray], chunks: np.ndarray) -> tuple:
    seen = p["embed"][_windows(chunks)].reshape(len(chunks) * SPOTS, WIDTH * EMBED)
    conv = (seen @ p["filters"]).reshape(len(chunks), SPOTS, FILTERS)
    top = conv.argmax(1)
    pooled = np.maximum(np.take_along_axis(conv, top[:, None], 1)[:, 0] + p["shift"], 0)
    hidden = np.tanh(pooled @ p["dense"] + p["dense_b"])
    return seen, top, pooled, hidden, hidden @ p["out"] + p["out_b"]


def logits(p: dict[str, np.ndarray], chunks: np.ndarray) -> np.ndarray:
    """Log-odds of each chunk."""
    out = np.zeros(len(chunks), np.float32)
    for i in range(0, len(chunks), 1024):
        part = chunks[i : i + 1024]
        seen = p["embed"][_windows(part)].reshape(-1, WIDTH * EMBED)
        pooled = np.maximum((seen @ p["filters"]).reshape(len(part), SPOTS, FILTERS).max(1) + p["shift"], 0)
        out[i : i + 1024] = (np.tanh(pooled @ p["dense"] + p["dense_b"]) @ p["out"] + p["out_b"])[:, 0]
    return out


def train(chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = 4, seed: int = 5) -> dict[str, np.ndarray]:
    """chunks (n, CHUNK) uint8, doc: index of each chunk's document (ascending), label 0 or 1 of each document."""
    rng = np.random.default_rng(seed)
    n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"embed": (0.5 * rng.standard_normal((256, EMBED))).astype(np.float32), "filters": n(WIDTH * EMBED, FILTERS), "shift": np.zeros(FILTERS, np.float32), "dense": n(FILTERS, HIDDEN), "dense_b": np.zeros(HIDDEN, np.float32), "out": n(HIDDEN, 1), "out_b": np.zeros(1, np.float32)}
    mean = float(np.clip(label.mean(), 0.01, 0.99))
    p["out_b"][:] = np.log(mean / (1 - mean))
    if len(set(label.tolist())) < 2:
        p["out"][:] = 0
        return p
    weight = np.where(label == 1, 0.5 / mean, 0.5 / (1 - mean)) ** 0.5
    adam, first = Adam(p, 3e-3), np.searchsorted(doc, np.arange(len(label) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for group in np.array_split(order, max(1, len(order) // 32)):
            pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in group])
            if not len(pick):
                continue
            size = np.array([first[d + 1] - first[d] for d in group])
            of = np.repeat(np.arange(len(group)), size)
            x = chunks[pick]
            seen, top, pooled, hidden, z = _forward(p, x)
            mean_z = np.bincount(of, z[:, 0], len(group)) / np.maximum(size, 1)
            prob = 1 / (1 + np.exp(-mean_z))
            dz = ((prob - label[group]) * weight[group] / np.maximum(size, 1))[of][:, None].astype(np.float32) / len(group)
            g = {"out": hidden.T @ dz, "out_b": dz.sum(0)}
            dh = (dz @ p["out"].T) * (1 - hidden**2)
            g["dense"], g["dense_b"] = pooled.T @ dh, dh.sum(0)
            dp = (dh @ p["dense"].T) * (pooled > 0)
            g["shift"] = dp.sum(0)
            rows = (np.arange(len(x))[:, None] * SPOTS + top).ravel()
            at = seen[rows].reshape(len(x), FILTERS, -1)
            g["filters"] = np.einsum("nfe,nf->ef", at, dp).astype(np.float32)
            back = np.einsum("nf,ef->nfe", dp, p["filters"]).reshape(-1, EMBED)
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], _windows(x).reshape(-1, WIDTH)[rows].ravel(), back)
            adam.step(p, g)
    return p


def cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping chunks of each text (the last padded with zero bytes), and each text's range of them."""
    n = np.diff(offs)
    each = np.where(n > 0, 1 + np.maximum(0, -(-(n - CHUNK) // SHIFT)), 0)
    doc = np.repeat(np.arange(len(n)), each)
    at = np.concatenate([[0], np.cumsum(each)])
    k = np.arange(at[-1]) - at[:-1][doc]
    place = (offs[:-1][doc] + k * SHIFT)[:, None] + np.arange(CHUNK)
    inside = place < offs[1:][doc][:, None]
    padded = np.append(buf, np.uint8(0))
    return np.where(inside, padded[np.minimum(place, len(buf))], np.uint8(0)), at


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_column: str = "text", label_column: str = "quality", rows: int = 3000) -> dict[str, np.ndarray]:
    """Parameters learned from all chunks of at most `rows` labelled documents, the first by a hash of their key.

    Labels or keys that are null teach nothing; of several labels of a key the largest counts, and every document with
    that key is read. Without labelled texts, or with one label only, every text gets the same prior.
    """
    picked = labels.where(F.col(label_column).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label_column).cast("int").alias("label")).groupBy(key).agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col(key), F.lit(3)), key).limit(rows)
    joined = docs.where(F.col(text_column).isNotNull()).select(key, F.col(text_column).alias("text")).join(F.broadcast(picked), key).select(F.col(key).cast("bigint").alias("id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in text_chunks(b.column(2)):
                x, at = cut(buf, offs)
                n = len(offs) - 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), b.column(1).slice(row, n), pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary())], ["id", "label", "x"])

    got = sorted(((r["id"], r["label"], bytes(r["x"])) for r in joined.mapInArrow(run, "id bigint, label int, x binary").collect()))
    if not got:
        return train(np.zeros((0, CHUNK), np.uint8), np.zeros(0, int), np.array([1]))
    x = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, CHUNK)
    return train(x, np.repeat(np.arange(len(got)), [len(r[2]) // CHUNK for r in got]), np.array([r[1] for r in got]))


def score(docs: DataFrame, model: dict[str, np.ndarray], text_column: str = "text") -> DataFrame:
    """docs with score: the probability of label 1 of each whole text. Null and empty texts get the prior that training started from and moved.

    A column named score is replaced; other columns stay.
    """
    keep = [c for c in docs.columns if c != "score"]
    docs = docs.select(*keep)
    at = keep.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for row, buf, offs in text_chunks(b.column(at), 1 << 18):
                x, first = cut(buf, offs)
                total = np.concatenate([[0.0], np.cumsum(logits(model, x), dtype=np.float64)])
                n = np.diff(first)
                out[row : row + len(n)] = np.where(n > 0, np.diff(total[first]) / np.maximum(n, 1), float(model["out_b"][0]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-out)))], [*keep, "score"])

    return docs.mapInArrow(run, StructType(list(docs.schema)).add("score", "double"))


def quality_of_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels of rows whose crc32(doc_id) mod 3 is 1 are never read."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs, labels.where(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", F.expr("int(score >= 0.5)").alias("predicted"))
