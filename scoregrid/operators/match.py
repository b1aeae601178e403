"""One-to-one matching: greedy folds of boxes in Catalyst, of shapes and optimal assignment in Arrow batches of frames, set areas by scanlines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import adaptive_iou_bar, box_iou, ratio
from ..functions.raster import raster, shape_iou
from .shapes import compared_shapes, greedy_shapes, united

FRAME = ("run_id", "frame")
BOX = ("x1", "y1", "x2", "y2")


def _sides(gt: DataFrame, pred: DataFrame, keys: tuple[str, ...], how: str, order: list[Column]) -> DataFrame:
    """One row a key: truth boxes g in det_ord order and predictions p in the given order; a missing side is empty."""
    g = gt.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("det_ord", *BOX))).alias("g"))
    p = pred.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("score") if "score" in pred.columns else F.lit(0.0).alias("score"), *BOX))).alias("p"))
    both = g.join(p, list(keys), how)
    return both.withColumns({c: F.coalesce(c, F.array().cast(both.schema[c].dataType)) for c in ("g", "p")})


def _fold(items: Column, others: Column, value, accept) -> Column:
    """Each item takes the free other of the largest value (ties: the first); accept(best) decides.

    Returns array<struct(item, value, hit)>; the state is the set of taken places.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.filter(F.transform(items, lambda i: F.struct(i.alias("item"), F.lit(0.0).alias("value"), F.lit(False).alias("hit"))), lambda x: F.lit(False)).alias("out"))

    def step(acc: Column, item: Column) -> Column:
        free = F.filter(F.transform(others, lambda o, i: F.struct(value(item, o).alias("v"), (-i).alias("i"), o.alias("o"))), lambda c: ~F.array_contains(acc["used"], -c["i"]))
        best = F.array_max(free)
        return F.transform(F.array(best), lambda b: F.struct(b.alias("b"), F.coalesce(accept(b), F.lit(False)).alias("hit")))[0]

    def merge(acc: Column, item: Column) -> Column:
        def build(s: Column) -> Column:
            used = F.when(s["hit"], F.array_append(acc["used"], -s["b"]["i"])).otherwise(acc["used"])
            row = F.struct(item.alias("item"), F.coalesce(s["b"]["v"], F.lit(0.0)).alias("value"), s["hit"].alias("hit"))
            return F.struct(used.alias("used"), F.array_append(acc["out"], row).alias("out"))

        return F.transform(F.array(step(acc, item)), build)[0]

    return F.aggregate(items, start, merge)["out"]


def shape_bar(iou: float | None = None) -> Column:
    return adaptive_iou_bar(F.struct(*BOX)) if iou is None else F.lit(float(iou))


def greedy_match(gt: DataFrame, pred: DataFrame, iou: float | None = None) -> DataFrame:
    """(run_id, cls, frame, det_ord, score, tp): predictions by confidence take the best free truth shape of their class and frame.

    iou: a constant bar; None: the bar depends on the box area of the best free truth shape, and no other one is tried.
    A column polygon on either side makes shapes of both: two boxes meet by area, all other pairs by pixels (see raster, shapes).
    Frames are independent, so the key is (run, class, frame) and groups stay small.
    """
    if "polygon" in gt.columns or "polygon" in pred.columns:
        found = greedy_shapes(united(gt, pred), shape_bar(iou))
        return found.select(*[F.col(c).cast(pred.schema[c].dataType).alias(c) for c in ("run_id", "cls", "frame", "det_ord", "score")], "tp")
    keys = ("run_id", "cls", "frame")
    both = _sides(gt, pred, keys, "right", [(-F.col("score")).alias("by"), F.col("det_ord")])
    bar = (lambda b: adaptive_iou_bar(b["o"])) if iou is None else (lambda b: F.lit(float(iou)))
    got = _fold(F.col("p"), F.col("g"), box_iou, lambda b: (b["v"] > 0) & (b["v"] >= bar(b)))
    return both.select(*keys, F.explode(got).alias("m")).select(*keys, F.col("m.item.det_ord").alias("det_ord"), F.col("m.item.score").alias("score"), F.col("m.hit").alias("tp"))


def compare_outputs(expected: DataFrame, actual: DataFrame, bar: float = 0.95, expected_frames: DataFrame | None = None, actual_frames: DataFrame | None = None) -> DataFrame:
    """(run_id, frame, n_expected, n_actual, matched, matched_iou, mean_iou, passed) on frames that both sides have: in expected order each shape takes the best free actual shape of its class.

    The mean divides by the expected count; a frame without shapes on both sides scores 1, a frame of extras only 0.
    A column polygon makes shapes polygons, as in greedy_match. expected_frames, actual_frames: (run_id, frame) of all frames; left out, the frames with shapes.
    """
    common = (expected if expected_frames is None else expected_frames).select(*FRAME).distinct().join((actual if actual_frames is None else actual_frames).select(*FRAME).distinct(), list(FRAME))
    if "polygon" in expected.columns or "polygon" in actual.columns:
        out = compared_shapes(united(expected, actual))
    else:
        both = _sides(expected, actual, ("run_id", "frame", "cls"), "full", [F.col("det_ord")])
        m = both.withColumn("m", _fold(F.col("g"), F.col("p"), box_iou, lambda b: b["v"] > 0))
        hit = F.filter("m", lambda x: x["hit"])
        rows = m.select("run_id", "frame", F.size("g").alias("ne"), F.size("p").alias("na"), F.size(hit).alias("nm"), F.aggregate(hit, F.lit(0.0), lambda a, x: a + x["value"]).alias("s"))
        out = rows.groupBy(*FRAME).agg(F.sum("ne").alias("n_expected"), F.sum("na").alias("n_actual"), F.sum("nm").alias("matched"), F.sum("s").alias("matched_iou"))
    return _verdict(common.join(out, list(FRAME), "left").na.fill(0, ["n_expected", "n_actual", "matched"]).na.fill(0.0, ["matched_iou"]), bar)


def compare_shapes(both: DataFrame, bar: float = 0.95, outline: Column | None = None) -> DataFrame:
    """compare_outputs() of the two tables in united(), on the frames that both have shapes in."""
    return _verdict(compared_shapes(both, outline).where("n_expected > 0 and n_actual > 0 and run_id is not null and frame is not null"), bar)


def _verdict(counted: DataFrame, bar: float) -> DataFrame:
    mean = F.when((F.col("n_expected") == 0) & (F.col("n_actual") == 0), 1.0).otherwise(ratio(F.col("matched_iou"), F.col("n_expected")))
    return counted.select(*FRAME, "n_expected", "n_actual", "matched", "matched_iou", mean.alias("mean_iou"), (mean >= bar).alias("passed"))


def comparison_verdicts(compared: DataFrame, runs: DataFrame, bar: float = 0.95) -> DataFrame:
    """(run_id, reason, passed, mean_iou, matched_mean_iou, missing, extra, missing_ratio, extra_ratio, frames_compared) of each run of `runs`.

    A run whose sides share no frame fails with the reason no_common_frames.
    """
    missing, extra = F.greatest(F.col("n_expected") - F.col("matched"), F.lit(0)), F.greatest(F.col("n_actual") - F.col("matched"), F.lit(0))
    total = compared.groupBy("run_id").agg(F.avg("mean_iou").alias("mean_iou"), F.sum("matched_iou").alias("s"), F.sum("matched").alias("m"), F.sum(missing).alias("missing"), F.sum(extra).alias("extra"), F.sum("n_expected").alias("ne"), F.sum("n_actual").alias("na"), F.count("*").alias("frames_compared"))
    both = runs.select("run_id").distinct().join(total, "run_id", "left").na.fill(0, ["missing", "extra", "frames_compared", "m", "ne", "na"])
    lost = F.col("frames_compared") == 0
    return both.select("run_id", F.when(lost, "no_common_frames").alias("reason"), F.coalesce(F.col("mean_iou") >= bar, F.lit(False)).alias("passed"), "mean_iou", ratio(F.col("s"), F.col("m")).alias("matched_mean_iou"), "missing", "extra", (F.col("missing") / F.greatest(F.col("ne"), F.lit(1))).alias("missing_ratio"), (F.col("extra") / F.greatest(F.col("na"), F.lit(1))).alias("extra_ratio"), "frames_compared")


def soft_drift(matched: Column, missing: Column, extra: Column, mean_iou: Column) -> Column:
    return (matched > 0) & (missing <= 2) & (extra <= 2) & (mean_iou >= 0.95)


def _assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            done[j0] = True
            row = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            free = ~done[1:]
            better = free & (row < low[1:])
            low[1:][better], way[1:][better] = row[better], j0
            j1 = int(np.where(done, np.inf, low).argmin())
            step = low[j1]
            u[owner[done]] += step
            v[done] -= step
            low[~done] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _columns(boxes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, coordinates, labels) of a column of lists of boxes; a null list is empty."""
    flat = boxes.flatten()
    size = np.where(boxes.is_null(), 0, np.asarray(boxes.value_lengths().fill_null(0)))
    xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in BOX], 1)
    return np.concatenate([[0], np.cumsum(size)]), xy, flat.field("cls").to_numpy(zero_copy_only=False)


def both_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(run_id, frame, n_gt, n_pred, ious, strict): both results of optimal_pairs(), from one pass over the frames."""
    return _optimal(gt, pred, (False, True), "run_id bigint, frame bigint, n_gt int, n_pred int, ious array<float>, strict array<float>")


def optimal_pairs(gt: DataFrame, pred: DataFrame, strict: bool = False) -> DataFrame:
    """(run_id, frame, n_gt, n_pred, ious): IoU of the pairs of a best one-to-one assignment of each frame.

    strict: pairs of different labels count 0. IoUs are single precision, so that a value at a bar still passes it.
    Many frames share an Arrow batch; a frame's boxes are one row's arrays.
    """
    return _optimal(gt, pred, (strict,), "run_id bigint, frame bigint, n_gt int, n_pred int, ious array<float>")


def _optimal(gt: DataFrame, pred: DataFrame, kinds: tuple[bool, ...], schema: str) -> DataFrame:
    g = gt.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("det_ord", "cls", *BOX))).alias("g"))
    p = pred.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("det_ord", "cls", *BOX))).alias("p"))
    both = g.join(p, list(FRAME), "full")

    def run(batches):
        for b in batches:
            one, two = (_columns(b.column(k)) for k in (2, 3))
            out: list[list] = [[] for _ in kinds]
            for i in range(b.num_rows):
                x, y = slice(one[0][i], one[0][i + 1]), slice(two[0][i], two[0][i + 1])
                if x.start == x.stop or y.start == y.stop:
                    for values in out:
                        values.append([])
                    continue
                a, c = one[1][x], two[1][y]
                w = np.clip(np.minimum(a[:, None, 2], c[None, :, 2]) - np.maximum(a[:, None, 0], c[None, :, 0]), 0, None)
                h = np.clip(np.minimum(a[:, None, 3], c[None, :, 3]) - np.maximum(a[:, None, 1], c[None, :, 1]), 0, None)
                size = lambda z: np.clip(z[:, 2] - z[:, 0], 0, None) * np.clip(z[:, 3] - z[:, 1], 0, None)
                union = size(a)[:, None] + size(c)[None] - w * h
                iou = np.divide(w * h, union, out=np.zeros_like(union), where=union > 0).astype(np.float32)
                for values, strict in zip(out, kinds, strict=True):
                    worth = np.where(one[2][x][:, None] != two[2][y][None], np.float32(0), iou) if strict else iou
                    m = worth.T if len(a) > len(c) else worth
                    values.append(m[np.arange(len(m)), _assign(1.0 - m.astype(float))].tolist())
            names = [c.split(" ")[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.diff(s[0]), pa.int32()) for s in (one, two)), *(pa.array(v, pa.list_(pa.float32())) for v in out)], names)

    return both.select(*FRAME, "g", "p").mapInArrow(run, schema)


def frame_f1(pairs: DataFrame, *bars: float) -> DataFrame:
    """(run_id, frame, f1): mean over bars of 2 TP / (truth + predictions); both empty 1, one empty 0."""
    tp = lambda t: F.size(F.filter("ious", lambda x: x >= F.lit(t).cast("float")))
    total = F.col("n_gt") + F.col("n_pred")
    f1 = sum((ratio(2.0 * tp(t), total) for t in bars), F.lit(0.0)) / len(bars)
    return pairs.select(*FRAME, F.when(total == 0, 1.0).otherwise(f1).alias("f1"))


def union_area(boxes: DataFrame, keys: tuple[str, ...], width: int = 960, height: int = 540) -> DataFrame:
    """Pixels that a key's boxes cover inside the image; keys without a box inside have no row.

    The boxes' own edges cut the image into slabs; in a slab boxes are merged from left to right. A key is a frame, so
    its boxes are few; nothing is multiplied by pixels or lines.
    """
    cut = boxes.select(*keys, F.greatest("x1", F.lit(0)).alias("x1"), F.greatest("y1", F.lit(0)).alias("y1"), F.least("x2", F.lit(width)).alias("x2"), F.least("y2", F.lit(height)).alias("y2")).where("x1 < x2 and y1 < y2")
    framed = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("bigint").alias(c) for c in BOX]))).alias("b"))
    framed = framed.withColumn("y", F.expr("array_sort(array_distinct(flatten(transform(b, r -> array(r.y1, r.y2)))))"))
    line = "aggregate(filter(b, r -> r.y1 <= top and r.y2 > top), struct(-1L as far, 0L as n), (a, r) -> struct(greatest(a.far, r.x2) as far, a.n + greatest(r.x2 - greatest(r.x1, a.far), 0L) as n), a -> a.n)"
    slabs = f"aggregate(transform(slice(y, 1, size(y) - 1), (top, i) -> (y[i + 1] - top) * {line}), 0L, (a, n) -> a + n)"
    return framed.select(*keys, F.expr(slabs).alias("pixels"))


def set_iou(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(A + B - U) / U of two sets of boxes by key; both empty 1."""
    cols = [*keys, *BOX]
    u = union_area(a.select(*cols).unionByName(b.select(*cols)), keys).withColumnRenamed("pixels", "u")
    both = u.join(union_area(a, keys).withColumnRenamed("pixels", "a"), list(keys), "left").join(union_area(b, keys).withColumnRenamed("pixels", "b"), list(keys), "left").na.fill(0, ["a", "b"])
    return both.select(*keys, F.when(F.col("u") > 0, (F.col("a") + F.col("b") - F.col("u")) / F.col("u")).otherwise(1.0).alias("iou"))


def polygon_area_iou(rows: DataFrame, keys: tuple[str, ...], a: str = "a", b: str = "b") -> DataFrame:
    """IoU of two integer polygons a row (arrays of structs x, y), by pixel centres on scanlines with the even-odd rule.

    This is a definition of our own; rasterisers that also paint the boundary differ by its pixels.
    """
    uid = rows.withColumn("_u", F.monotonically_increasing_id()) if not keys else rows

    def spans(which: str) -> DataFrame:
        edge = uid.select(*keys, F.explode(F.transform(F.col(which), lambda p, i: F.struct(p["x"].alias("xa"), p["y"].alias("ya"), F.get(F.col(which), (i + 1) % F.size(which))["x"].alias("xb"), F.get(F.col(which), (i + 1) % F.size(which))["y"].alias("yb")))).alias("e")).select(*keys, "e.*").where("ya <> yb")
        line = edge.withColumn("y", F.explode(F.sequence(F.least("ya", "yb"), F.greatest("ya", "yb") - 1)))
        cross = line.select(*keys, "y", (F.col("xa") + (F.col("y") + 0.5 - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))).alias("x"))
        w = Window.partitionBy(*keys, "y").orderBy("x")
        pairs = cross.withColumns({"k": F.row_number().over(w), "x2": F.lead("x").over(w)}).where("k % 2 = 1 and x2 is not null")
        return pairs.select(*keys, "y", F.ceil(F.col("x") - 0.5).alias("x1"), F.ceil(F.col("x2") - 0.5).alias("x2")).where("x1 < x2")

    sa, sb = spans(a), spans(b)
    size = lambda s, n: s.groupBy(*keys).agg(F.sum(F.col("x2") - F.col("x1")).alias(n))
    both = sa.join(sb.withColumnsRenamed({"x1": "p1", "x2": "p2"}), [*keys, "y"]).groupBy(*keys).agg(F.sum(F.greatest(F.least("x2", "p2") - F.greatest("x1", "p1"), F.lit(0))).alias("i"))
    out = uid.select(*keys).distinct().join(size(sa, "na"), list(keys), "left").join(size(sb, "nb"), list(keys), "left").join(both, list(keys), "left").na.fill(0, ["na", "nb", "i"])
    return out.select(*keys, F.when(F.col("na") + F.col("nb") - F.col("i") > 0, F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).otherwise(1.0).alias("iou"))


def polygon_iou(rows: DataFrame, a: str = "a", b: str = "b", empty: float = 1.0) -> DataFrame:
    """rows with iou: the pixels that two integer polygons (arrays of structs x, y) share, over those that either has (see raster). Null where a side is null; `empty` where neither paints a pixel."""
    drawn = rows.withColumns({"_a": raster(a), "_b": raster(b)})
    none = F.lit(0).cast("bigint")
    shape = lambda m: F.struct(*[none.alias(c) for c in BOX], F.col(m).alias("mask"))
    return drawn.withColumn("iou", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), shape_iou(shape("_a"), shape("_b"), empty))).drop("_a", "_b")


def label_modes(pred: DataFrame) -> DataFrame:
    """(run_id, frame, cls, mode): boxes, polygons or mixed, by what the predictions of a label hold; needs has_polygon."""
    return pred.groupBy(*FRAME, "cls").agg(F.bool_or("has_polygon").alias("p"), F.bool_or(~F.col("has_polygon")).alias("b")).select(*FRAME, "cls", F.when(F.col("p") & F.col("b"), "mixed").when(F.col("p"), "polygons").otherwise("boxes").alias("mode"))


def project_truth(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """gt with the mode in which each truth box counts: its label's, else mixed if the frame has any, else boxes."""
    modes = label_modes(pred)
    any_mode = modes.select(*FRAME).distinct().withColumn("_any", F.lit(True))
    return gt.join(modes, [*FRAME, "cls"], "left").join(any_mode, list(FRAME), "left").withColumn("mode", F.coalesce("mode", F.when(F.col("_any"), "mixed").otherwise("boxes"))).drop("_any")


def project_shapes(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """gt as the predictions of its frame ask for it: truth whose label is predicted in boxes only loses its polygon. Both have a column polygon."""
    modes = pred.withColumn("has_polygon", F.col("polygon").isNotNull())
    return project_truth(gt, modes).withColumn("polygon", F.when(F.col("mode") != "boxes", F.col("polygon"))).drop("mode")
