"""LM scoring: a causal self-attention model over subword ids, trained and applied in numpy.

A text is the ids of its lower-cased words in a row (a public tokenizer, each word behind a space), then an end. The net
reads the ids in windows of WINDOW + BACK that overlap by BACK: one batched matrix product gives all attention scores of a
window, a mask hides later ids and other texts, and each id is predicted once, from the BACK ids before it. It gives
the probability of each of CLASSES classes of ids: a frequent id alone, the rare ids that begin a word, those that go
on, the end. It does so in two steps, the class's group of up to GROUP classes and the class in it, so that a
prediction costs two short rows of logits. Inside a class ids have their shares in all training texts. That is mixed
with the shares of classes after the class before, counted in all training texts; the mixing weight is fitted on
what the net said of every training id before its last lesson with it.

A word whose first id i has been predicted is then either one that training texts hold, or spelled: with c of the C
occurrences of V words that begin with i, it has max(c - D, 0) / C + D * V / C * spelling, where spelling is the product of
the predictions of its later ids and of a word's end after them. So probabilities of all texts sum to one, and counts
of ids, pairs and words cover every training text.

The net learns from every id of every training text, in runs of words. A run's hash names the round, one of ROUNDS, of its
lesson; where a corpus holds fewer than LEAST_IDS ids, runs come again in other rounds. Each task takes
gradient steps on its own runs from common weights, and the weights of all tasks are averaged after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, LOWER, crc_mod, discard, id_bounds, id_range, mix, span_hashes, stash, text_chunks, word_spans
from .quality import Adam
from .tokens import encoder, vocabulary_path

BACK, DIM, CLASSES, GROUP = 8, 32, 1024, 32
RUN, ROUNDS, LEAST_IDS, TASK_IDS, MOST_TASK = 48, 5, 4_000_000, 400_000, 4_000_000
BATCH, MOST_BATCH, STEPS = 512, 4096, 800  # targets of a gradient step; larger ones where a task has enough for STEPS of them
CHUNK_BYTES, SLICE, WINDOW = 12 << 20, 1 << 13, 16


@dataclass
class Classes:
    """id -> class, and the groups of classes: END first, then what begins a word, then what goes on, the latter in groups of their own."""

    of: np.ndarray
    group: np.ndarray  # of each class
    slot: np.ndarray  # of each class in its group
    begin: int  # the first group of what goes on

    @property
    def count(self) -> int:
        return len(self.group)

    @classmethod
    def frequent(cls, counts: np.ndarray, begins: np.ndarray, names: list[str], n: int = CLASSES) -> Classes:
        """The n - 3 most frequent ids alone (ties to the smaller id), ids that are spelled alike in groups; the last row of counts is the end of a text."""
        ids = len(counts) - 1
        top = np.lexsort((np.arange(ids), -counts[:ids]))[: n - 3]
        top = sorted(top[counts[top] > 0].tolist(), key=lambda i: names[i])
        first, later = ([i for i in top if begins[i] == k] for k in (True, False))
        of = np.where(np.append(begins, True), 1, 2 + len(first))
        of[first], of[later], of[ids] = 2 + np.arange(len(first)), 3 + len(first) + np.arange(len(later)), 0
        begin = -(-(2 + len(first)) // GROUP)
        group = np.concatenate([np.arange(2 + len(first)) // GROUP, begin + np.arange(1 + len(later)) // GROUP])
        return cls(of, group, np.concatenate([np.arange(2 + len(first)), np.arange(1 + len(later))]) % GROUP, begin)

    def log_share(self, counts: np.ndarray) -> np.ndarray:
        """Natural log of each id's part of its class; an id that was never met counts a half."""
        c = np.maximum(counts.astype(float), 0.5)
        return np.log(c / np.bincount(self.of, c, self.count)[self.of])


class Attention:
    """Predicts the class of the next id from the BACK ids before it; items are classes too."""

    def __init__(self, classes: Classes | None, counts: np.ndarray | None = None, seed: int = 1):
        """counts: occurrences of each class, for the first weights."""
        self.classes = classes
        if classes is None:
            return
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        groups = int(classes.group[-1]) + 1
        own = (np.ones(classes.count) if counts is None else counts + 1.0).astype(float)
        inside, whole = np.full((groups, GROUP), -30.0), np.bincount(classes.group, own)  # slots without a class stay out of reach
        inside[classes.group, classes.slot] = np.log(own / whole[classes.group])
        self.p = {"e": (0.5 * rng.standard_normal((classes.count, DIM))).astype(np.float32), "q": n(DIM, DIM), "k": n(DIM, DIM), "rel": np.zeros(BACK, np.float32), "r": n(DIM, 2 * DIM), "v": n(DIM, 2 * DIM), "b": np.zeros(2 * DIM, np.float32)}
        self.p |= {"g": n(2 * DIM, groups), "gc": np.log(whole / whole.sum()).astype(np.float32), "u": n(groups, 2 * DIM, GROUP), "c": inside.astype(np.float32)}

    def _hidden(self, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.maximum(q @ self.p["r"] + m @ self.p["v"] + self.p["b"], 0)

    def look(self, items: np.ndarray, mask: np.ndarray) -> tuple:
        """items (n, BACK): the last BACK ids, the last one first; mask: 1 where there is one."""
        p = self.p
        c = p["e"][items]
        q = c[:, 0]
        s = np.matmul(c, ((q @ p["q"]) @ p["k"].T)[:, :, None])[:, :, 0] / np.float32(np.sqrt(DIM)) + p["rel"]
        a = np.exp(np.minimum(s, 30)) * mask
        a /= a.sum(1, keepdims=True)
        m = np.matmul(a[:, None], c)[:, 0]
        return c, q, a, m, self._hidden(q, m)

    def _groups(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(order of targets by group, the group of each in that order, (group, from, to) in that order)."""
        own = self.classes.group[y].astype(np.int16)
        order = np.argsort(own, kind="stable")
        own = own[order]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        return order, own, list(zip(own[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(own)], strict=True))

    def log_probs(self, items: np.ndarray, mask: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target class, a plain form for tests."""
        h = self.look(items, mask)[4]
        z, own = h @ self.p["g"] + self.p["gc"], self.classes.group[y]
        inside = np.einsum("nd,ndm->nm", h, self.p["u"][own]) + self.p["c"][own]
        at = np.arange(len(y))
        return z[at, own] - np.log(np.exp(z).sum(1)) + inside[at, self.classes.slot[y]] - np.log(np.exp(inside).sum(1))

    def _inside(self, h: np.ndarray, group: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits of the classes in each target's group; h is in the order of _groups()."""
        w = np.empty((len(h), GROUP), h.dtype)
        for k, i, j in groups:
            np.matmul(h[i:j], self.p["u"][k], out=w[i:j])
        w += self.p["c"].take(group, 0)
        return w

    def _top(self, h: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of what follows the hidden layer, the gradient before that layer, and the probability of each target."""
        p, n, at = self.p, len(y), np.arange(len(y))
        order, group, groups = self._groups(y)
        h, back_to = h.take(order, 0), np.empty_like(order)
        back_to[order] = at

        def turn(z: np.ndarray, target: np.ndarray) -> np.ndarray:  # softmax less the targets, over n; gives the targets' probabilities
            if z.max() > 60:
                np.minimum(z, 60, out=z)
            np.exp(z, out=z)
            z *= (1 / (n * (z @ np.ones(z.shape[1], z.dtype))))[:, None]
            own = z[at, target]
            z[at, target] = own - z.dtype.type(1 / n)
            return own * n

        dz = h @ p["g"]
        dz += p["gc"]
        chance = turn(dz, group)
        dw = self._inside(h, group, groups)
        chance *= turn(dw, self.classes.slot[y[order]])
        g = {"g": h.T @ dz, "gc": np.ones(n, h.dtype) @ dz, "u": np.zeros_like(p["u"]), "c": np.zeros_like(p["c"])}
        dt, back = dz @ p["g"].T, np.empty_like(h)
        for k, i, j in groups:
            np.matmul(h[i:j].T, dw[i:j], out=g["u"][k])
            np.matmul(dw[i:j], p["u"][k].T, out=back[i:j])
        g["c"][[k for k, _, _ in groups]] = np.add.reduceat(dw, [i for _, i, _ in groups])
        dt += back
        dt *= h > 0
        return g, dt.take(back_to, 0), chance.take(back_to)

    def lesson(self, item: np.ndarray, text: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """gradients() of targets in a row, by windows that overlap, and the probability that each target had. item and text as in scores()."""
        p, root, n, f = self.p, np.sqrt(DIM), len(y), self.p["e"].dtype
        blocks = -(-n // WINDOW)
        behind, seen, far = self._far()
        scale = (p["q"] @ p["k"].T / root).astype(f)
        x, t = np.zeros((BACK + WINDOW * blocks, DIM + 1), f), np.full(BACK + WINDOW * blocks, -1, np.int32)
        x[:, DIM] = 1  # the last column adds up what a query sees
        x[BACK : BACK + n, :DIM], t[BACK : BACK + n] = p["e"].take(item, 0), text
        keys = np.lib.stride_tricks.as_strided(x, (blocks, WINDOW + BACK, DIM + 1), (WINDOW * x.strides[0], *x.strides))
        kt = np.lib.stride_tricks.as_strided(t, (blocks, WINDOW + BACK), (WINDOW * t.strides[0], t.strides[0]))
        # of each block, one above the other: attention and its gradient; what meets them on the way back to the keys
        both, ask = np.empty((blocks, 2 * WINDOW, WINDOW + BACK), f), np.zeros((blocks, 2 * WINDOW, DIM + 1), f)
        a, ds, dm1, asks = both[:, :WINDOW], both[:, WINDOW:], ask[:, :WINDOW], ask[:, WINDOW:, :DIM]
        whole = np.zeros((WINDOW * blocks, DIM + 1), f)
        whole[:n, :DIM] = (p["e"] @ scale).take(item, 0)
        asks[:] = whole[:, :DIM].reshape(blocks, WINDOW, DIM)
        np.matmul(asks, keys[:, :, :DIM].transpose(0, 2, 1), out=a)
        if a.max() > 30:
            np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= far
        mixed = np.flatnonzero(kt[:, 0] != kt[:, -1])
        a[mixed] *= kt[mixed][:, None, :] == kt[mixed, BACK:][:, :, None]
        m = np.matmul(a, keys)
        whole_row = 1 / m[:, :, DIM:]  # a row sees at least itself
        m *= whole_row
        a *= whole_row
        m = m.reshape(-1, DIM + 1)[:n, :DIM]
        h = m @ p["v"]
        h += (p["e"] @ p["r"] + p["b"]).take(item, 0)
        np.maximum(h, 0, out=h)
        g, dt, chance = self._top(h, y)
        q = x[BACK : BACK + n]
        both_r = q.T @ dt
        g["r"], g["v"], g["b"] = both_r[:DIM], m.T @ dt, both_r[DIM]
        dm = dt @ p["v"].T
        whole[:n, :DIM] = dm
        whole[:n, DIM] = -np.einsum("nd,nd->n", dm, m)
        dm1[:] = whole.reshape(blocks, WINDOW, DIM + 1)
        np.matmul(dm1, keys.transpose(0, 2, 1), out=ds)
        ds *= a
        g["rel"] = np.bincount(behind[seen], ds.sum(0)[seen], BACK).astype(f)
        sc = np.matmul(ds, keys[:, :, :DIM]).reshape(-1, DIM)[:n]
        d_scale = q[:, :DIM].T @ sc / f.type(root)
        g["q"], g["k"] = d_scale @ p["k"], d_scale.T @ p["q"]
        dk = np.matmul(both.transpose(0, 2, 1), ask[:, :, :DIM])
        dx = np.zeros((blocks + 1, WINDOW, DIM), f)
        dx[:-1] = dk[:, :WINDOW]
        dx[1:, :BACK] += dk[:, WINDOW:]
        de = dx.reshape(-1, DIM)[BACK : BACK + n]
        de += dt @ p["r"].T
        de += sc @ scale.T
        order = np.argsort(item.astype(np.int16), kind="stable")
        edge = np.flatnonzero(np.diff(item[order], prepend=-1))
        g["e"] = np.zeros_like(p["e"])
        g["e"][item[order[edge]]] = np.add.reduceat(de.take(order, 0), edge)
        return g, chance

    def _far(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of query i and key j of a window: how many items the key stands before the query, whether it is seen, and the factor of its place."""
        behind = np.arange(WINDOW)[:, None] - np.arange(WINDOW + BACK) + BACK
        seen = (behind >= 0) & (behind < BACK)
        return behind, seen, np.where(seen, np.exp(self.p["rel"][np.clip(behind, 0, BACK - 1)]), 0).astype(self.p["rel"].dtype)

    def gradients(self, items: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of the targets."""
        p, root = self.p, np.float32(np.sqrt(DIM))
        c, q, a, m, h = self.look(items, mask)
        g, dt, _ = self._top(h, y)
        g["r"], g["v"], g["b"] = q.T @ dt, m.T @ dt, dt.sum(0)
        dq, dm = dt @ p["r"].T, dt @ p["v"].T
        da = np.matmul(c, dm[:, :, None])[:, :, 0]
        ds = a * (da - (a * da).sum(1, keepdims=True))
        g["rel"] = ds.sum(0)
        qq = q @ p["q"]
        sc = np.matmul(ds[:, None], c)[:, 0] / root  # d of (qq k^T)
        g["k"] = sc.T @ qq
        dqq = sc @ p["k"]
        g["q"] = q.T @ dqq
        dc = a[:, :, None] * dm[:, None, :] + ds[:, :, None] * ((qq @ p["k"].T) / root)[:, None, :]
        dc[:, 0] += dq + dqq @ p["q"].T
        at = items.ravel()
        order = np.argsort(at.astype(np.int16), kind="stable")
        edge = np.flatnonzero(np.diff(at[order], prepend=-1))
        g["e"] = np.zeros_like(p["e"])
        g["e"][at[order][edge]] = np.add.reduceat(dc.reshape(-1, DIM)[order], edge)
        return g

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What only depends on items: how much each item (row) looks at each other, what its value gives the hidden layer (the last column is 1), and what it gives as a query."""
        p = self.p
        look = (p["e"] @ (p["q"] @ p["k"].T / np.float32(np.sqrt(DIM)))) @ p["e"].T
        np.exp(np.minimum(look, 30, out=look), out=look)
        return look, np.column_stack([p["e"], np.ones(len(p["e"]), np.float32)]).astype(np.float32), (p["e"] @ p["r"] + p["b"]).astype(np.float32)

    def scores(self, item: np.ndarray, text: np.ndarray, y: np.ndarray, tables: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each target's class, log probability of all that begins a word), by windows that overlap.

        item[i]: the class of what stands before target i; text[i]: the text that target i belongs to; tables: tables(), if they are made already.
        """
        p, n = self.p, len(y)
        look, value, own = tables or self.tables()
        out, edge = np.zeros(n, np.float32), np.zeros(n, np.float32)
        place = np.exp(p["rel"]).astype(np.float32)
        ones = np.ones(GROUP, np.float32)
        halves = np.ones((len(p["gc"]), 2), np.float32)  # all groups, and those that begin a word
        halves[self.classes.begin :, 1] = 0
        blocks = -(-min(n, SLICE) // WINDOW)
        s, x = np.zeros((blocks, WINDOW, WINDOW + BACK), np.float32), np.zeros((BACK + WINDOW * blocks, DIM + 1), np.float32)
        # query w of a block sees the item k before it at w + BACK - k of the block's items; what it does not see stays 0
        bands = [np.lib.stride_tricks.as_strided(s[:, :, BACK - k :], (blocks, WINDOW), (s.strides[0], s.strides[1] + s.strides[2])) for k in range(BACK)]
        keys = np.lib.stride_tricks.as_strided(x, (blocks, WINDOW + BACK, DIM + 1), (WINDOW * x.strides[0], *x.strides))
        for i in range(0, n, SLICE):
            j = min(n, i + SLICE)
            lo, m = max(0, i - BACK), j - i
            near = np.concatenate([np.zeros(BACK - (i - lo), item.dtype), item[lo:j]])
            x[: BACK + m] = value.take(near, 0)
            starts = np.flatnonzero(np.diff(text[lo:j], prepend=-1)) + lo  # of texts
            if lo and text[lo - 1] == text[lo]:
                starts = starts[1:]
            row, seen = item[i:j].astype(np.int64) * look.shape[1], np.zeros(blocks * WINDOW, np.float32)
            for k in range(BACK):
                seen[:m] = look.take(row + near[BACK - k : BACK - k + m])
                seen[:m] *= place[k]
                hidden = (starts[:, None] + np.arange(k) - i).ravel()
                seen[hidden[(hidden >= 0) & (hidden < m)]] = 0
                bands[k][:] = seen.reshape(blocks, WINDOW)
            got = np.matmul(s, keys).reshape(-1, DIM + 1)[:m]
            h = (got[:, :DIM] * (1 / np.maximum(got[:, DIM:], np.float32(1e-20)))) @ p["v"]
            h += own.take(item[i:j], 0)
            np.maximum(h, 0, out=h)
            order, group, groups = self._groups(y[i:j])
            h, slot, at = h.take(order, 0), self.classes.slot[y[i:j][order]], np.arange(m)
            z = h @ p["g"]
            z += p["gc"]
            mine = z[at, group]
            np.exp(z, out=z)
            sums = z @ halves
            w = self._inside(h, group, groups)
            mine += w[at, slot]
            np.exp(w, out=w)
            out[i + order] = mine - np.log(sums[:, 0] * (w @ ones))
            edge[i + order] = np.log(sums[:, 1] / sums[:, 0])
        return out, edge


@dataclass
class Model:
    classes: Classes
    net: Attention
    odds: np.ndarray | list  # of the training ids: how many lie in each bin of log(net's probability / that of the class before), see ODDS

    @property
    def end(self) -> int:
        return len(self.classes.of) - 1


ODDS = np.linspace(-20, 20, 801)  # middles of the bins


def odds_of(net: np.ndarray, row: np.ndarray, y: np.ndarray, pairs: np.ndarray, every: np.ndarray) -> np.ndarray:
    """How many targets lie in each bin of ODDS; a target is taken out of the counts of pairs that foretell it. pairs has two more columns, each row's sum and its number of followers; every: pair_shares()."""
    own = pairs[row, y]
    types = np.maximum(pairs[row, -1] - (own <= 1), 1)
    pair = (np.maximum(own - 1, 0) + types * every[y]) / (np.maximum(pairs[row, -2] - 1, 0) + types)
    at = np.rint((np.log(np.maximum(net, 1e-30)) - np.log(pair)) / (ODDS[1] - ODDS[0])) + len(ODDS) // 2
    return np.bincount(np.clip(at, 0, len(ODDS) - 1).astype(np.int64), minlength=len(ODDS))


def steps(model: Model, runs: list[np.ndarray], last: np.ndarray, seed: int, rate: float, pairs: np.ndarray, every: np.ndarray) -> tuple[int, np.ndarray]:
    """One pass of gradient steps over runs of ids, in a fixed order; returns how many targets there were, and the odds of those whose run is at its last lesson, before its step."""
    of, done, adam, rng = model.classes.of, 0, Adam(model.net.p, rate), np.random.default_rng(seed)
    size = np.array([len(r) - 1 for r in runs])
    batch, odds = min(MOST_BATCH, max(BATCH, int(size.sum()) // STEPS)), np.zeros(len(ODDS), np.int64)
    order = rng.permutation(len(runs))
    order = order[size[order] > 0]
    for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // batch)) + 1):
        if not len(part):
            continue
        row, y = of[np.concatenate([runs[i][:-1] for i in part])], of[np.concatenate([runs[i][1:] for i in part])]
        g, chance = model.net.lesson(row, np.repeat(np.arange(len(part)), size[part]), y)
        new = np.repeat(last[part], size[part])
        odds += odds_of(chance[new], row[new], y[new], pairs, every)
        adam.step(model.net.p, g)
        done += len(y)
    return done, odds


def word_ids(encode, keys: np.ndarray, code: np.ndarray, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words in a row, offsets of the words in them); keys[code] are the words' hashes."""
    entry = encode.entries(keys, code, low, s, e, " ")[code] if len(keys) else np.zeros(0, np.int64)
    length = encode.len[entry].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(length)])
    return encode.flat[np.repeat(encode.at[entry].astype(np.int64) - at[:-1], length) + np.arange(at[-1])].astype(np.int64), at


def _runs(vocabulary: str, end: int):
    """All runs of RUN words of every text, with a hash of the words in each and of the text's id, so that copies part; a run begins with the end of a text before the text's first word, and with the last id of the word before it elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        kind = id_kind(end)
        edge = np.array([end], kind)
        for b in batches:
            salt = b.column(1).to_numpy().view(np.uint64)
            for row, buf, offs in text_chunks(b.column(0), CHUNK // 2):
                low = LOWER[buf]
                s, e, first = word_spans(low, offs)
                h = span_hashes(low, s, e)
                n = np.diff(first)
                blocks = np.maximum(1, -(-n // RUN))
                doc = np.repeat(np.arange(len(n)), blocks)
                a = first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * RUN
                z = np.minimum(a + RUN, first[1:][doc])
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
                chance = mix(total[z] - total[a] + salt[row + doc])
                before = a > first[doc]  # a word before the run lends its last id
                code, keys = pd.factorize(h)
                ids, at = word_ids(encode, keys, code, low, s, e)
                ids = ids.astype(kind)
                got = []
                for lead, x, z_, stop in zip(before.tolist(), a.tolist(), z.tolist(), (z == first[doc + 1]).tolist(), strict=True):
                    own = ids[at[x] - 1 if lead else at[x] : at[z_]]
                    got.append(own if lead and not stop else np.concatenate([own[:0] if lead else edge, own, edge if stop else own[:0]]))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in got], pa.binary()), pa.array([len(x) for x in got], pa.int64()), pa.array((chance >> np.uint64(1)).astype(np.int64))], ["ids", "n", "h"])

    return run


def id_kind(end: int) -> type:
    return np.uint16 if end < 1 << 16 else np.uint32


def _ids(column: pa.Array, end: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), id_kind(end)) for x in column]


def _average(t: pa.Table) -> pa.Table:
    n = t["n"].to_numpy().astype(np.float64)
    w = sum(k * np.frombuffer(x.as_buffer(), np.float64) for k, x in zip(n, t["w"].combine_chunks(), strict=True)) / n.sum()
    odds = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t["odds"].combine_chunks())
    return pa.table({"part": pa.array([0], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "w": pa.array([w.tobytes()], pa.binary()), "odds": pa.array([odds.tobytes()], pa.binary())})


def classes_of(texts: DataFrame, vocabulary: str) -> tuple[Model, DataFrame, np.ndarray]:
    """(a net with its initial weights, the runs of all training texts (columns id, text) as a written table, the occurrences of ids in them)."""
    tokenizer = encoder(vocabulary).tokenizer
    names_of = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    begins = np.array([x.startswith("\u0120") for x in names_of])
    end = len(begins)
    runs = stash(texts.select("text", F.xxhash64("id").alias("salt")).mapInArrow(_runs(vocabulary, end), "ids binary, n bigint, h bigint"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for b in batches:
            got = _ids(b.column(0), end)
            if got:
                total += np.bincount(np.concatenate(got), minlength=end + 1) - np.bincount([x[0] for x in got], minlength=end + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(end + 1, np.int64)
    for r in runs.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
        counts[r["id"]] = r["n"]
    classes = Classes.frequent(counts, begins, names_of)
    return Model(classes, Attention(classes, np.bincount(classes.of, counts, classes.count)), []), runs, counts


def fit(model: Model, runs: DataFrame, n_ids: int, pairs: np.ndarray, rounds: int = ROUNDS) -> None:
    """Teaches the net every run of all training texts: see the module's docstring. pairs: counts of class pairs. Without a run it keeps its initial weights."""
    again = max(1, min(rounds, -(-LEAST_IDS // max(1, n_ids))))
    share = max(TASK_IDS, min(MOST_TASK, n_ids // 64))  # ids of a task
    names, end = sorted(model.net.p), model.end
    table, every = np.column_stack([pairs, pairs.sum(1), (pairs > 0).sum(1)]).astype(np.float32), pair_every(pairs).astype(np.float32)
    odds = np.zeros(len(ODDS), np.int64)
    schema = "part bigint, n bigint, w binary, odds binary"
    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            mine, last = [], []
            for b in batches:  # about `share` ids in all
                mine += _ids(b.column(0), end)
                last.append(np.minimum(b.column(1).to_numpy() % rounds + again, rounds) - 1 == turn)
            if mine:
                own = Model(model.classes, Attention(None), [])
                own.net.classes = model.classes
                own.net.p = {k: v.copy() for k, v in model.net.p.items()}
                done, met = steps(own, mine, np.concatenate(last), turn, 8e-3 * 0.6**turn, table, every)
                w = np.concatenate([own.net.p[k].ravel() for k in names]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([max(1, done)], pa.int64()), pa.array([w.tobytes()], pa.binary()), pa.array([met.tobytes()], pa.binary())], ["part", "n", "w", "odds"])

        now = runs.where(f"pmod({turn} - h, {rounds}) < {again}").select("ids", "h")
        some = max(1, -(-n_ids * again // (rounds * share)))
        now = now.repartition(some, "h").sortWithinPartitions("h", "ids") if some > 1 else now.coalesce(1).sortWithinPartitions("h", "ids")
        told = now.mapInArrow(run, schema).withColumn("part", F.expr(f"pmod(part, {int(np.sqrt(some)) + 1})"))
        got = told.groupBy("part").applyInArrow(_average, schema).withColumn("part", F.lit(0).cast("bigint")).groupBy("part").applyInArrow(_average, schema).first()
        if got is not None:
            w, at = np.frombuffer(got["w"], np.float64), 0
            odds += np.frombuffer(got["odds"], np.int64)
            for k in names:
                size = model.net.p[k].size
                model.net.p[k] = w[at : at + size].reshape(model.net.p[k].shape).astype(np.float32)
                at += size
    model.odds = odds


class Mixed:
    """The net's prediction of an id, mixed with the share of its class after the class before."""

    def __init__(self, model: Model, pairs: np.ndarray, counts: np.ndarray):
        """pairs (row class, class) and counts (id, end) of all training texts."""
        self.model = model
        of = model.classes.of
        self.share = pair_shares(pairs).astype(np.float32)
        self.share_edge = self.share[:, model.classes.group < model.classes.begin].sum(1)
        self.inside = model.classes.log_share(counts)
        self.part = 0.5
        if len(model.odds) and model.odds.sum():
            ratio = np.exp(ODDS)
            for _ in range(50):
                self.part = float((model.odds * (self.part * ratio / (self.part * ratio + 1 - self.part))).sum() / model.odds.sum())

    def logs(self, before: np.ndarray, text: np.ndarray, ids: np.ndarray, tables: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each id, log probability that a word or the end begins there), natural logs; tables: the net's, if they are made already."""
        of = self.model.classes.of
        row, y = of[before], of[ids]
        net, edge = self.model.net.scores(row, text, y, tables)
        both = self.part * np.exp(net) + (1 - self.part) * self.share[row, y]
        return np.log(both) + self.inside[ids], np.log(self.part * np.exp(edge) + (1 - self.part) * self.share_edge[row])


def pair_shares(pairs: np.ndarray) -> np.ndarray:
    """Probability of each class (column) after each class (row), from counts of pairs; the weight of a row's smoothing is the number of its followers (Witten-Bell)."""
    types = np.maximum((pairs > 0).sum(1, keepdims=True), 1)
    return (pairs + types * pair_every(pairs)) / (pairs.sum(1, keepdims=True) + types)


def pair_every(pairs: np.ndarray) -> np.ndarray:
    return (pairs.sum(0) + 1) / (pairs.sum() + pairs.shape[1])


WORD, PAIR, ID = 0, 1, 2


def _count(model: Model, vocabulary: str):
    """(kind, chunk, h, first, n): WORD rows are a chunk's words with their first ids and occurrences in training texts, each once a task as long as it holds them; PAIR and ID rows are occurrences of class pairs (h = class before * CLASSES + class) and of ids in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(model, vocabulary, batches)

    return run


def _counted(model: Model, vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[pd.DataFrame]] = {}
    pairs, uses, end = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(model.end + 1, np.int64), model.end
    encode = encoder(vocabulary)
    columns = ["kind", "chunk", "h", "first", "n"]

    def rows(kind: int, chunk: int, h: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        k = len(h)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(np.full(k, chunk, np.int32)), pa.array(h), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int64))], columns)

    def out(chunk: int) -> pa.RecordBatch:
        total = pd.concat(held.pop(chunk)).groupby("h").agg(first=("first", "first"), n=("n", "sum"))
        return rows(WORD, chunk, total.index.to_numpy().view(np.int64), total["first"].to_numpy(), total["n"].to_numpy())

    for b in batches:
        chunks, train_row = b.column(0).to_numpy(), ~b.column(1).to_numpy(zero_copy_only=False)
        for row, buf, offs in text_chunks(b.column(2)):
            low = LOWER[buf]
            s, e, first = word_spans(low, offs)
            h = span_hashes(low, s, e)
            n = np.diff(first)
            code, keys = pd.factorize(h)
            spot = np.zeros(len(keys), np.int64)
            spot[code[::-1]] = np.arange(len(code))[::-1]
            ids, at = word_ids(encode, keys, np.arange(len(keys)), low, s[spot], e[spot])  # each distinct word once
            begin, last = ids[at[:-1]], ids[at[1:] - 1]
            of, used = np.repeat(chunks[row : row + len(n)], n), np.repeat(train_row[row : row + len(n)], n)
            near = np.unique(of)
            for c in near:
                mine = of == c if len(near) > 1 else slice(None)
                uses_here = np.bincount(code[mine][used[mine]], minlength=len(keys))
                there = np.flatnonzero(uses_here) if used[mine].all() else np.unique(code[mine])
                held.setdefault(int(c), []).append(pd.DataFrame({"h": keys[there], "first": begin[there], "n": uses_here[there]}))
            # pairs and ids inside words, by how often each is met, then those from word to word and at both ends of texts
            times = np.bincount(code[used], minlength=len(keys))
            size = np.diff(at)
            inner = np.ones(len(ids), bool)
            inner[at[:-1]] = False
            weight = np.repeat(times, size)
            of_id = model.classes.of[ids]
            np.add.at(pairs, (of_id[:-1] * CLASSES + of_id[1:])[inner[1:]], weight[1:][inner[1:]])
            uses += np.bincount(ids, weight, end + 1).astype(np.int64)
            words, before, text, _ = stream_of(code, np.arange(len(code) + 1), first, -1)
            kept = train_row[row : row + len(n)][text]
            edge = model.classes.of[end]
            tail, lead = np.append(model.classes.of[last], edge), np.append(model.classes.of[begin], edge)  # place -1: the end of a text
            np.add.at(pairs, (tail[before] * CLASSES + lead[words])[kept], 1)
            uses[end] += int((words[kept] < 0).sum())
            for c in [c for c, x in held.items() if sum(map(len, x)) > 1_500_000]:
                yield out(c)
        while len(held) > 8 or sum(len(x) for v in held.values() for x in v) > 2_000_000:
            yield out(min(held))
    for c in list(held):
        yield out(c)
    for kind, counts in ((PAIR, pairs), (ID, uses)):
        some = np.flatnonzero(counts)
        yield rows(kind, -1, some, np.zeros(len(some)), counts[some])


def stream_of(ids: np.ndarray, at: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words first[i] to first[i + 1] hold ids at[w] to at[w + 1]: all targets (ids, and an end behind each text), what stands before each (an end before a text), the text of each, and the place of each word's first id."""
    n = len(first) - 1
    cut = at[first]
    text = np.repeat(np.arange(n), np.diff(cut) + 1)
    place = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(cut))
    stream = np.full(len(ids) + n, end, np.int64)
    stream[place] = ids
    return stream, np.append(end, stream[:-1]) if len(stream) else stream, text, at[:-1] + np.repeat(np.arange(n), np.diff(first))


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, known_logs double, n_ids bigint, score double"


def _score(mixed: Mixed, vocabulary: str, n_ends: int, first_n: np.ndarray, first_v: np.ndarray, less: float):
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        encode, end, tables = encoder(vocabulary), mixed.model.end, mixed.model.net.tables()
        h_all, c_all = counts["h"].to_numpy().view(np.uint64), counts["c"].to_numpy()
        order = np.argsort(h_all)
        h_all, c_all = h_all[order], c_all[order]
        out, names, held = [], texts["id"].to_pylist(), texts["held"].to_pylist()
        for row, buf, offs in text_chunks(texts["text"], 1 << 18):
            low = LOWER[buf]
            s, e, first = word_spans(low, offs)
            n = np.diff(first)
            h = span_hashes(low, s, e)
            code, keys = pd.factorize(h)
            c = c_all[np.minimum(np.searchsorted(h_all, keys), max(0, len(h_all) - 1))][code] if len(keys) else np.zeros(0, np.int64)
            ids, at = word_ids(encode, keys, code, low, s, e)
            stream, before, text, start = stream_of(ids, at, first, end)
            logs, edge = mixed.logs(before, text, stream, tables)
            # a word, its first id given: counted, or spelled by its later ids and the edge after them
            later = logs.copy()
            later[start] = 0
            later[stream == end] = 0
            sums = np.concatenate([[0.0], np.cumsum(later, dtype=np.float64)])
            stop = start + np.diff(at)  # what follows the word
            spelled = np.exp(sums[stop] - sums[start] + edge[stop])
            total, types = first_n[ids[at[:-1]]], first_v[ids[at[:-1]]]
            known = np.where(total > 0, np.maximum(c - less, 0) / np.maximum(total, 1), 0) + np.where(total > 0, less * types / np.maximum(total, 1), 1) * spelled
            each = np.zeros(len(stream))
            each[start] = logs[start] - edge[start] + np.log(np.maximum(known, 1e-300))
            ends = stream == end
            each[ends] = logs[ends] - edge[ends]
            word_text = np.repeat(np.arange(len(n)), n)
            base = np.bincount(word_text, np.log10(c + 1.0), len(n)) + np.log10(n_ends + 1.0)
            k = slice(row, row + len(n))
            out.append(pa.table({"doc_id": pa.array(names[k], pa.int64()), "held_out": pa.array(held[k], pa.bool_()), "n_tokens": n + 1, "n_known": np.bincount(word_text, c > 0, len(n)).astype(np.int64) + (n_ends > 0), "known_logs": base, "n_ids": np.bincount(text, minlength=len(n)), "score": np.bincount(text, each / np.log(10), len(n))}))
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids) for each row; nothing is learned where held_out is true.

    Null and empty texts are one end. Null ids and repeated ids are rows like others. Without training rows all counts
    are 0 and the net keeps its initial weights. An empty table gives no rows. Other columns are ignored.

    Word counts travel as (chunk, word) rows, each word once for a chunk of about 12 MB of texts with neighbouring
    ids, and come back the same way; texts are shuffled once.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    docs = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"), held_out.alias("held"))
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~F.col("held")).alias("ends")).first()
    parts = max(1, min(size["n"], -(-size["bytes"] // CHUNK_BYTES)))
    model, runs, id_counts = classes_of(docs.where("not held"), vocabulary)
    place = F.when(F.col("id").isNull(), F.expr(f"{parts} + pmod(xxhash64(text), {parts})")).otherwise(id_range(F.col("id"), id_bounds(docs, "id", parts)))
    chunked = docs.withColumn("chunk", place.cast("int"))
    met = chunked.select("chunk", "held", "text").mapInArrow(_count(model, vocabulary), "kind int, chunk int, h bigint, first int, n bigint")
    window = "over (partition by kind, h"
    met = stash(met.withColumns({"c": F.expr(f"sum(n) {window})"), "lead": F.expr(f"row_number() {window} order by chunk) = 1")}).select("kind", "chunk", "h", "first", "c", "lead"))
    first_n, first_v = np.zeros(model.end), np.zeros(model.end)
    for r in met.where(f"lead and kind = {WORD}").groupBy("first").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect():  # a row for each id
        first_n[r["first"]], first_v[r["first"]] = r["n"], r["v"]
    tables = []
    for kind, wide in ((PAIR, CLASSES * CLASSES), (ID, model.end + 1)):
        table, got = np.zeros(wide), met.where(f"lead and kind = {kind}").select("h", "c").toPandas()  # at most a million pairs of classes
        table[got["h"].to_numpy(np.int64)] = got["c"].to_numpy(float)
        tables.append(table)
    k = model.classes.count
    pairs = tables[0].reshape(CLASSES, CLASSES)[:k, :k]
    fit(model, runs, int(id_counts.sum()), pairs)
    discard(runs)
    mixed = Mixed(model, pairs, tables[1])
    model.odds = []
    few = met.where(f"lead and kind = {WORD}").agg(F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    less = max(0.1, min(0.95, few["one"] / max(1, few["one"] + 2 * few["two"])))  # D, from the words met once and twice
    n_all, n_types = int(first_n.sum()) + size["ends"], int(first_v.sum()) + (size["ends"] > 0)
    counts = met.where(f"kind = {WORD}").select("chunk", "h", "c")
    scored = chunked.select("chunk", "id", "held", "text").groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_score(mixed, vocabulary, size["ends"], first_n, first_v, less), RESULT)
    base = F.col("known_logs") - F.col("n_tokens") * F.lit(float(np.log10(n_all + n_types + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", "n_ids")


def lm_of_all(docs: DataFrame) -> DataFrame:
    return score_texts(docs, crc_mod(F.col("doc_id"), 7) == 2)
