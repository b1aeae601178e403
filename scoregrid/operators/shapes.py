"""Boxes and polygons of many frames matched at once, in Arrow batches of whole frames.

The pixels of a polygon are those of functions.raster, and the order of choices is that of the folds in match.py. Spark deals
frames to tasks and sorts their rows; a batch holds some ten thousand of them, and neither masks nor pairs leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.raster import POINTS

FRAME = ("run_id", "frame")
BOX = ("x1", "y1", "x2", "y2")
ROWS = 40_000  # rows that are matched at once, if no frame has more
WORK = 2_000_000  # lines of edges and pairs that are held at once, if no frame has more


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables in one, with the column second; the score of the first is 0."""

    def rows(df: DataFrame, is_second: bool) -> DataFrame:
        score = F.col("score") if is_second and "score" in df.columns else F.lit(0.0)
        polygon = F.col("polygon") if "polygon" in df.columns else F.lit(None)
        return df.select(*FRAME, "cls", "det_ord", score.alias("score"), *BOX, polygon.cast(POINTS).alias("polygon"), F.lit(is_second).alias("second"))

    return rows(first, False).unionByName(rows(second, True))


def _by_frame(both: DataFrame, item: Column, bar: Column, outline: Column | None, *by: Column) -> DataFrame:
    """The rows of a frame in one task, sorted as the match takes them: others, then items by (by, det_ord). place counts a frame's rows.

    Only a grouping by frame is asked for, so a table already dealt by frame is not shuffled again. An outline is made of a
    row's other columns after the sort; without it rows have a column polygon.
    """
    rows = both.withColumns({"item": item} | {f"by{i}": c for i, c in enumerate(by)})
    order = ["cls", "item", *[f"by{i}" for i in range(len(by))], "det_ord", "score", *BOX]
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("frame", "run_id").orderBy(*order)))
    boxes = [F.col(c).cast("double").alias(c) for c in BOX]
    return placed.sortWithinPartitions("frame", "run_id", *order).select(*FRAME, "cls", "item", "det_ord", "score", *boxes, bar.cast("double").alias("bar"), (F.col("polygon") if outline is None else outline).cast(POINTS).alias("polygon"), "place")


def greedy_shapes(both: DataFrame, bar: Column, projected: bool = False, count_truth: bool = False, outline: Column | None = None) -> DataFrame:
    """(run_id, cls, frame, det_ord, score, tp): rows of the second table of united() by confidence take the best free one of the first where its bar allows.

    projected: the first's polygons count only where a shape of the second with their label and frame has one, as in project_shapes().
    count_truth: also n_gt, null in those rows; further rows, in which tp is null, hold numbers of the first's rows by run and class, to be summed.
    outline: the polygon as an expression of other columns, so that it is neither shuffled nor sorted.
    """
    rows = _by_frame(both, F.col("second"), bar, outline, F.when(F.col("second"), -F.col("score").cast("double")).otherwise(0.0))
    kept = ["run_id", "cls", "frame", "det_ord", "score"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", tp boolean" + (", n_gt bigint" if count_truth else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_frames(batches):
            m = _Match(t, 1.0, projected)
            items = pa.array(np.flatnonzero(m.item))
            out = t.select(kept).take(items).append_column("tp", pa.array(m.hit[m.item]))
            if count_truth:
                out = out.append_column("n_gt", pa.nulls(len(items), pa.int64()))
                n = t.select(["run_id", "cls"]).filter(pa.array(~m.item)).group_by(["run_id", "cls"]).aggregate([([], "count_all")])
                more = {c: pa.nulls(n.num_rows, out.schema.field(c).type) for c in out.column_names} | {"run_id": n.column("run_id"), "cls": n.column("cls"), "n_gt": n.column("count_all")}
                out = pa.concat_tables([out, pa.table(more, schema=out.schema)])
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def compared_shapes(both: DataFrame, outline: Column | None = None) -> DataFrame:
    """(run_id, frame, n_expected, n_actual, matched, matched_iou) of each frame: rows of the first table of united() take the best free one of the second, whatever the overlap."""
    rows = _by_frame(both, ~F.col("second"), F.lit(0.0), outline)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in FRAME) + ", n_expected bigint, n_actual bigint, matched bigint, matched_iou double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_frames(batches):
            m = _Match(t, 0.0, False)
            n = m.frame[-1] + 1
            out = t.select(list(FRAME)).take(pa.array(np.flatnonzero(m.first)))
            for name, chosen in (("n_expected", m.item), ("n_actual", ~m.item), ("matched", m.hit)):
                out = out.append_column(name, pa.array(np.bincount(m.frame[chosen], minlength=n)))
            total = np.bincount(m.frame[m.hit], weights=m.value[m.hit], minlength=n)
            yield from out.append_column("matched_iou", pa.array(total.astype(float))).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole frames, of about ROWS rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        starts = np.flatnonzero(b.column(b.schema.get_field_index("place")).to_numpy() == 1)
        if n + b.num_rows > ROWS and len(starts) and n + starts[-1]:
            yield pa.Table.from_batches([*held, b.slice(0, starts[-1])]).combine_chunks()
            b, held, n = b.slice(starts[-1]), [], 0
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _places(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each of the counts, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class _Match:
    """The match of the rows of some frames: hit and value by row (of items), frame by row, first row of each frame."""

    def __init__(self, t: pa.Table, empty: float, projected: bool):
        self.empty, n = empty, t.num_rows
        one = lambda c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        self.item = item = one("item").to_numpy(zero_copy_only=False).astype(bool)
        self.bar = one("bar").to_numpy(zero_copy_only=False)
        self.box = np.stack([one(c).to_numpy(zero_copy_only=False) for c in BOX], 1)
        self.first = one("place").to_numpy() == 1
        self.frame = np.cumsum(self.first) - 1
        label = one("cls").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begins = self.first.copy()
        begins[1:] |= label[1:] != label[:-1]
        group = np.cumsum(begins) - 1
        start = np.flatnonzero(begins)
        known = ~(np.asarray(one("run_id").is_null()) | np.asarray(one("frame").is_null()) | (label < 0))
        n_items, n_others = (np.bincount(group[s], minlength=len(start)) for s in (item, ~item))
        n_others_met = np.where(known[start], n_others, 0)  # a null key meets nothing

        lists = one("polygon")
        drawn = np.asarray(lists.is_valid())
        if projected:
            asked = np.bincount(group[item & drawn], minlength=len(start)) > 0
            drawn = drawn & (item | asked[group])
        self._outlines(lists, drawn)

        self.hit, self.value, self.taken = np.zeros(n, bool), np.zeros(n), np.zeros(n, bool)
        row = np.arange(n)
        rank = row - (start + n_others)[group]
        met = (n_items > 0) & (n_others_met > 0)
        work = np.where(met, n_items * n_others_met, 0) + np.bincount(group, weights=self.lines, minlength=len(start)).astype(np.int64)
        piece = np.cumsum(work) // WORK
        for p in np.unique(piece[met]):
            chosen = item & met[group] & (piece[group] == p)
            items = np.flatnonzero(chosen)
            self._fold(items[np.argsort(rank[items], kind="stable")], rank, start[group], n_others[group])

    def _outlines(self, lists: pa.Array, drawn: np.ndarray) -> None:
        """Points and bounds of the rows with a polygon; lines is about the number of pixel rows that a row's edges cross."""
        size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        self.begin = np.cumsum(size) - size
        self.size = np.where(drawn, size, 0)
        self.polygon = self.size > 0
        x, y = lists.flatten().flatten()
        self.known_point = np.asarray(x.is_valid()) & np.asarray(y.is_valid())
        self.x, self.y = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in (x, y))
        b = np.nan_to_num(self.box).astype(np.int64)
        self.low, self.high = np.minimum(b[:, 1], b[:, 3]), np.maximum(b[:, 1], b[:, 3])
        self.left, self.right = np.minimum(b[:, 0], b[:, 2]), np.maximum(b[:, 0], b[:, 2])
        self.lost = np.isnan(self.box).any(1)  # without a place: meets nothing
        self.some = (self.high >= 0) & (self.right >= 0)  # surely paints a pixel
        rows = np.flatnonzero(self.polygon)
        if len(rows):
            at = np.repeat(self.begin[rows], self.size[rows]) + _places(self.size[rows])
            cut = np.cumsum(self.size[rows]) - self.size[rows]
            bounds = lambda f, v, absent: f.reduceat(np.where(self.known_point[at], v[at], absent), cut)
            far = np.iinfo(np.int64).max
            self.low[rows], self.high[rows] = bounds(np.minimum, self.y, far), bounds(np.maximum, self.y, -far)
            self.left[rows], self.right[rows] = bounds(np.minimum, self.x, far), bounds(np.maximum, self.x, -far)
            self.lost[rows] = self.low[rows] == far
            self.some[rows] = np.logical_or.reduceat(self.known_point[at] & (self.x[at] >= 0) & (self.y[at] >= 0), cut) & (np.logical_and.reduceat(self.known_point[at], cut))
        self.high[self.lost], self.low[self.lost] = -1, 0
        self.lines = np.where(self.polygon, self.size * (np.maximum(self.high, 0) - np.maximum(self.low, 0) + 1), 0)

    def _fold(self, items: np.ndarray, rank: np.ndarray, start: np.ndarray, n_others: np.ndarray) -> None:
        """Items, those of lower ranks first, take the free other of the largest value, ties the first, where its bar allows."""
        ends = np.cumsum(n_others[items])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(WORK, ends[-1], WORK), "left") + 1, [len(items)]]))
        masks: _Masks | None = None
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = items[lo:hi]
            reps = n_others[part]
            other = np.repeat(start[part], reps) + _places(reps)
            item = np.repeat(part, reps)
            drawn = (self.polygon[item] | self.polygon[other]) & ~self.lost[item] & ~self.lost[other]
            value = self._box_values(item, other)
            if drawn.any():
                i, o = item[drawn], other[drawn]
                v = np.zeros(len(i))
                near = (np.minimum(self.high[i], self.high[o]) >= np.maximum(np.maximum(self.low[i], self.low[o]), 0)) & (np.minimum(self.right[i], self.right[o]) >= np.maximum(np.maximum(self.left[i], self.left[o]), 0))
                near |= ~(self.some[i] | self.some[o])
                if near.any():
                    shapes = np.unique(np.concatenate([i[near], o[near]]))
                    masks = masks if masks is not None and masks.has(shapes) else _Masks(self, shapes)
                    v[near] = masks.iou(i[near], o[near], self.empty)
                value[drawn] = v
            value[self.lost[item] | self.lost[other]] = -1.0
            begin = np.cumsum(reps) - reps
            for k in np.unique(rank[part]):
                a, b = np.searchsorted(rank[part], [k, k + 1])
                s = slice(begin[a], begin[b] if b < len(part) else len(other))
                free = np.where(self.taken[other[s]], -2.0, value[s])
                at = begin[a:b] - begin[a]
                best = np.maximum.reduceat(free, at)
                place = np.minimum.reduceat(np.where(free == np.repeat(best, reps[a:b]), np.arange(len(free)), len(free)), at)
                won = other[s][place]
                hit = (best > 0) & (best >= self.bar[won])
                self.hit[part[a:b]], self.value[part[a:b]] = hit, best
                self.taken[won[hit]] = True

    def _box_values(self, item: np.ndarray, other: np.ndarray) -> np.ndarray:
        """box_iou() of the boxes."""
        a, b = self.box[item], self.box[other]
        w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
        h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
        area = lambda c: np.maximum(c[:, 2] - c[:, 0], 0) * np.maximum(c[:, 3] - c[:, 1], 0)
        both = w * h
        union = area(a) + area(b) - both
        return np.divide(both, union, out=np.zeros(len(both)), where=(w > 0) & (h > 0) & (union > 0))


class _Masks:
    """The pixels of some rows of a match: spans by line, disjoint and from left to right."""

    def __init__(self, m: _Match, shapes: np.ndarray):
        self.shapes = shapes
        polygon = m.polygon[shapes]
        y0 = np.maximum(m.low[shapes], 0)
        lines = np.where(polygon, np.maximum(m.high[shapes], 0) - y0 + 1, np.maximum(m.high[shapes] - y0 + 1, 0) * (m.right[shapes] >= np.maximum(m.left[shapes], 0)))
        lines[m.lost[shapes]] = 0
        self.y0, self.lines, self.base = y0, lines, np.cumsum(lines) - lines
        p = np.flatnonzero(polygon)
        line, a, b = self._polygon_spans(m, shapes[p], y0[p], self.base[p])
        x = np.flatnonzero(~polygon)
        own = np.repeat(x, lines[x])
        box_line = self.base[own] + _places(lines[x])
        line, a, b = np.concatenate([line, box_line]), np.concatenate([a, np.maximum(m.left[shapes], 0)[own]]), np.concatenate([b, m.right[shapes][own]])
        order = _sorted(line, a)
        line, self.a, self.b = line[order], a[order], b[order]
        total = int(lines.sum())
        self.span = np.searchsorted(line, np.arange(total + 1))
        covered = np.concatenate([[0], np.cumsum(self.b - self.a + 1)])[self.span]
        self.pixels = covered[self.base + lines] - covered[self.base]

    def has(self, shapes: np.ndarray) -> bool:
        at = np.minimum(np.searchsorted(self.shapes, shapes), len(self.shapes) - 1)
        return bool((self.shapes[at] == shapes).all())

    def iou(self, one: np.ndarray, two: np.ndarray, empty: float) -> np.ndarray:
        s, t = np.searchsorted(self.shapes, one), np.searchsorted(self.shapes, two)
        y = np.maximum(self.y0[s], self.y0[t])
        n = np.maximum(np.minimum(self.y0[s] + self.lines[s], self.y0[t] + self.lines[t]) - y, 0)
        pair = np.repeat(np.arange(len(s)), n)
        at = y[pair] + _places(n)
        ls, lt = self.base[s][pair] + at - self.y0[s][pair], self.base[t][pair] + at - self.y0[t][pair]
        ns, nt = self.span[ls + 1] - self.span[ls], self.span[lt + 1] - self.span[lt]
        met = np.repeat(np.arange(len(pair)), ns * nt)
        k = _places(ns * nt)
        i, j = self.span[ls][met] + k // nt[met], self.span[lt][met] + k % nt[met]
        shared = np.maximum(np.minimum(self.b[i], self.b[j]) - np.maximum(self.a[i], self.a[j]) + 1, 0)
        both = np.bincount(pair[met], weights=shared, minlength=len(s))
        union = self.pixels[s] + self.pixels[t] - both
        return np.where(union > 0, both / np.where(union > 0, union, 1), empty)

    @staticmethod
    def _polygon_spans(m: _Match, rows: np.ndarray, y0: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, a, b): the merged spans of polygons, as functions.raster has them."""
        size = m.size[rows]
        own = np.repeat(np.arange(len(rows)), size)
        k = _places(size)
        begin = m.begin[rows][own]
        p, q = begin + k, begin + np.where(k + 1 < size[own], k + 1, 0)
        good = m.known_point[p] & m.known_point[q]
        own, p, q = own[good], p[good], q[good]
        px, py, qx, qy = m.x[p], m.y[p], m.x[q], m.y[q]
        steep = np.abs(qy - py) >= np.abs(qx - px)
        turn = np.where(steep, py > qy, px > qx)
        px, qx, py, qy = np.where(turn, qx, px), np.where(turn, px, qx), np.where(turn, qy, py), np.where(turn, py, qy)
        low, high = np.minimum(py, qy), np.maximum(py, qy)
        low_seen = np.maximum(low, 0)
        n = np.maximum(high - low_seen + 1, 0)
        e = np.repeat(np.arange(len(own)), n)
        y = low_seen[e] + _places(n)
        line = base[own][e] + y - y0[own][e]
        dx, dy = qx - px, qy - py
        level = (dy == 0)[e]
        up = y - py[e]
        part = up * dx[e] / np.where(dy == 0, 1, dy)[e]
        # crossings by line, two by two
        c = np.flatnonzero(~level & (y < high[e]))
        cl, cx = line[c], np.floor(px[e[c]] + part[c] + 0.5).astype(np.int64)
        order = _sorted(cl, cx)
        cl, cx = cl[order], cx[order]
        fresh = np.concatenate([[True], cl[1:] != cl[:-1]]) if len(cl) else np.zeros(0, bool)
        place = np.arange(len(cl)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        left = np.flatnonzero((place[:-1] % 2 == 0) & ~fresh[1:]) if len(cl) else np.zeros(0, np.int64)
        # edges: a pixel a line of steep ones, a stretch of flat ones
        one = px[e] + np.where(level, 0, np.floor(part + 0.5)).astype(np.int64)
        far = one.copy()
        f = np.flatnonzero(~steep[e])
        fp, fq, fx, fy, level, up = px[e[f]], qx[e[f]], dx[e[f]], dy[e[f]], level[f], up[f]
        wide = np.where(level, 1, 2 * fy)
        before, after = (2 * up - 1) * fx / wide, (2 * up + 1) * fx / wide
        rising = fy > 0
        one[f] = np.where(level, fp, np.maximum(fp, fp + np.where(rising, np.ceil(before), np.floor(after) + 1).astype(np.int64)))
        far[f] = np.where(level, fq, np.minimum(fq, fp + np.where(rising, np.ceil(after) - 1, np.floor(before)).astype(np.int64)))
        a, b = np.concatenate([cx[left], one]), np.concatenate([cx[left + 1], far])
        line = np.concatenate([cl[left], line])
        a = np.maximum(a, 0)
        seen = b >= a
        line, a, b = line[seen], a[seen], b[seen]
        if not len(line):
            return line, a, b
        order = _sorted(line, a)
        line, a, b = line[order], a[order], b[order]
        far = _farthest(line, b)
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (a[1:] > far[:-1] + 1)])
        last = np.concatenate([new[1:], [True]])
        return line[new], a[new], far[last]


def _sorted(line: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The order by line, then x."""
    if not len(x):
        return np.zeros(0, np.int64)
    low = int(x.min())
    width = int(x.max()) - low + 1
    if (int(line.max()) + 1) * width < 2**62:
        return np.argsort(line * width + (x - low), kind="stable")
    return np.lexsort((x, line))


def _farthest(line: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest of the ends b so far on the line, lines being in order."""
    values = None
    if (int(line.max()) + 1) * (int(b.max()) + 1) >= 2**62:
        values, b = np.unique(b, return_inverse=True)
    width = int(b.max()) + 1
    far = np.maximum.accumulate(line * width + b) - line * width
    return far if values is None else values[far]
