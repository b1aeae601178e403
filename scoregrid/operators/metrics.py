"""Detection pillars and element scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import economic_score, ratio
from .match import BOX, both_pairs, frame_f1, greedy_match, optimal_pairs, set_iou

METRICS: dict[tuple[str, str], Callable] = {}
SHARED: dict[tuple[str, str], tuple[str, Callable[[], Column]]] = {}
# what pillars of one run share: a table with run_id, made once however many of them ask for it
INTERMEDIATES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "pairs": both_pairs,
    "matches": lambda gt, pred: precision_recall(greedy_match(gt, pred), gt),
    "precision curve": lambda gt, pred: average_precision(greedy_match(gt, pred), gt),
    "truth smoothness": lambda gt, pred: smoothness(pred),
}


def register_metric(category: str, pillar: str):
    """Decorator: fn(gt, pred, params) -> DataFrame(run_id, score) becomes the pillar of a category."""

    def keep(fn: Callable) -> Callable:
        METRICS[(category, pillar)] = fn
        return fn

    return keep


def register_shared(category: str, pillar: str, intermediate: str):
    """Decorator: fn() -> Column, an aggregate over the rows of a run in one of INTERMEDIATES, becomes the pillar of a category."""

    def keep(fn: Callable[[], Column]) -> Callable[[], Column]:
        SHARED[(category, pillar)] = (intermediate, fn)
        return fn

    return keep


def element_pillars(category: str, pillars: list[str], gt: DataFrame, pred: DataFrame, params: dict | None = None) -> DataFrame:
    """(run_id, pillar, score) of the asked pillars of a category; one that nobody has registered raises.

    Pillars over one intermediate are aggregates of one grouping of it, so that boxes are assigned once for all of them;
    the others are computed by their own function. Every run that truth or predictions have gets a row a pillar, 0 where it has no value.
    """
    unknown = [p for p in pillars if (category, p) not in SHARED and (category, p) not in METRICS]
    if unknown:
        raise NotImplementedError(f"no metric of {category} is registered for {', '.join(unknown)}")
    out, of = [], {}
    for p in pillars:
        if (category, p) in SHARED:
            of.setdefault(SHARED[category, p][0], []).append(p)
        else:
            out.append(METRICS[category, p](gt, pred, params).select("run_id", F.lit(p).alias("pillar"), "score"))
    for name, asked in of.items():
        wide = INTERMEDIATES[name](gt, pred).groupBy("run_id").agg(*[SHARED[category, p][1]().alias(f"_{i}") for i, p in enumerate(asked)])
        long = F.explode(F.array(*[F.struct(F.lit(p).alias("pillar"), F.col(f"_{i}").cast("double").alias("score")) for i, p in enumerate(asked)]))
        out.append(wide.select("run_id", long.alias("l")).select("run_id", "l.*"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    every = gt.select("run_id").union(pred.select("run_id")).distinct().withColumn("pillar", F.explode(F.array(*[F.lit(p) for p in pillars])))
    return every.join(found, ["run_id", "pillar"], "left").na.fill(0.0, ["score"])


def _f1_column(ious: str, *bars: float) -> Column:
    """Mean over frames of the mean F1 over bars, of rows of both_pairs()."""
    total = F.col("n_gt") + F.col("n_pred")
    tp = lambda t: F.size(F.filter(ious, lambda x: x >= F.lit(t).cast("float")))
    return F.avg(F.when(total == 0, 1.0).otherwise(sum((ratio(2.0 * tp(t), total) for t in bars), F.lit(0.0)) / len(bars)))


register_shared("Detect", "placement", "pairs")(lambda: _f1_column("ious", 0.3, 0.5))
register_shared("Detect", "count", "pairs")(lambda: _f1_column("ious", 0.3))
register_shared("Detect", "label", "pairs")(lambda: _f1_column("strict", 0.3, 0.5))
register_shared("Detect", "precision", "matches")(lambda: F.max("precision"))
register_shared("Detect", "recall", "matches")(lambda: F.max("recall"))
register_shared("Detect", "false_positive", "matches")(lambda: F.max("false_positive"))
register_shared("Detect", "map", "precision curve")(lambda: F.avg("ap"))
register_shared("Detect", "smoothness", "truth smoothness")(lambda: F.max("score"))


def pillar_catalog(spark) -> DataFrame:
    return spark.createDataFrame(sorted(set(METRICS) | set(SHARED)) or [("", "")], "category string, pillar string").where("category <> ''")


def precision_recall(matches: DataFrame, gt: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(run_id, tp, fp, n_gt, precision, recall, false_positive): micro-averaged over classes, matched once for all pillars.

    false_positive is max(0, 1 - (FP / frames) / 10).
    """
    hits = matches.groupBy("run_id").agg(F.count_if("tp").alias("tp"), F.count_if(~F.col("tp")).alias("fp"))
    n = gt.groupBy("run_id").agg(F.count("*").alias("n_gt"))
    f = (frames if frames is not None else gt.select("run_id", "frame")).distinct().groupBy("run_id").agg(F.count("*").alias("n_frames"))
    both = n.join(hits, "run_id", "full").join(f, "run_id", "left").na.fill(0)
    tp, fp, total = F.col("tp"), F.col("fp"), F.col("n_gt")
    return both.select("run_id", "tp", "fp", "n_gt", ratio(tp, tp + fp).alias("precision"), ratio(tp, total).alias("recall"), F.greatest(F.lit(0.0), 1 - ratio(fp, F.col("n_frames")) / 10).alias("false_positive"))


def average_precision(matches: DataFrame, gt: DataFrame) -> DataFrame:
    """(run_id, cls, ap): area under the monotone precision envelope; classes without truth are left out.

    Only score, order and flag are sorted, never boxes. The envelope is a running maximum from the last row back.
    """
    n = gt.groupBy("run_id", "cls").agg(F.count("*").alias("n_gt"))
    w = Window.partitionBy("run_id", "cls").orderBy(F.desc("score"), "frame", "det_ord")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("run_id", "cls").orderBy("score", F.desc("frame"), F.desc("det_ord")).rowsBetween(Window.unboundedPreceding, 0)
    run = matches.select("run_id", "cls", "score", "frame", "det_ord", F.col("tp").cast("int").alias("tp")).join(n, ["run_id", "cls"])
    run = run.withColumns({"c": F.sum("tp").over(up), "k": F.count("*").over(up)}).withColumns({"p": F.col("c") / F.col("k"), "r": F.col("c") / F.col("n_gt")})
    run = run.withColumns({"e": F.max("p").over(back), "before": F.coalesce(F.lag("r").over(w), F.lit(0.0))})
    ap = run.groupBy("run_id", "cls").agg(F.sum((F.col("r") - F.col("before")) * F.col("e")).alias("ap"))
    return n.select("run_id", "cls").join(ap, ["run_id", "cls"], "left").na.fill(0.0, ["ap"])


def per_class_report(matches: DataFrame, gt: DataFrame) -> DataFrame:
    """(run_id, cls, n_gt, n_pred, tp, fp, fn, precision, recall, f1, ap) of each class that truth or predictions have; ap is null without truth."""
    n = gt.groupBy("run_id", "cls").agg(F.count("*").alias("n_gt"))
    hits = matches.groupBy("run_id", "cls").agg(F.count("*").alias("n_pred"), F.count_if("tp").alias("tp"))
    both = n.join(hits, ["run_id", "cls"], "full").na.fill(0, ["n_gt", "n_pred", "tp"]).join(average_precision(matches, gt), ["run_id", "cls"], "left")
    tp, g, p = F.col("tp"), F.col("n_gt"), F.col("n_pred")
    return both.select("run_id", "cls", "n_gt", "n_pred", "tp", (p - tp).alias("fp"), (g - tp).alias("fn"), ratio(tp, p).alias("precision"), ratio(tp, g).alias("recall"), ratio(2.0 * tp, g + p).alias("f1"), "ap")


def class_report_of(matches: DataFrame) -> DataFrame:
    """(run_id, cls, n_gt, tp, ap) of each class with truth, from one pass over the rows of greedy_shapes(count_truth=True).

    The curve is swept from its last row back: what stands before a row is the class's total less what came already, and
    the envelope is the maximum so far, so that rows are dealt and sorted once.
    """
    w = Window.partitionBy("run_id", "cls").orderBy("score", F.desc("frame"), F.desc("det_ord"))
    back, all_ = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hit = F.col("tp").cast("int")
    run = matches.select("run_id", "cls", "score", "frame", "det_ord", "tp", "n_gt")
    run = run.withColumns({"c": F.sum(hit).over(all_) - F.sum(hit).over(back) + hit, "k": F.count("tp").over(all_) - F.count("tp").over(back) + 1})
    run = run.withColumn("e", F.max(F.when(F.col("tp").isNotNull(), F.col("c") / F.col("k"))).over(back))
    out = run.groupBy("run_id", "cls").agg(F.sum("n_gt").alias("n_gt"), F.count_if("tp").alias("tp"), F.sum(F.when(F.col("tp"), F.col("e"))).alias("s"))
    return out.where("n_gt > 0").select("run_id", "cls", "n_gt", "tp", F.coalesce(F.col("s") / F.col("n_gt"), F.lit(0.0)).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.groupBy("run_id").agg(F.avg("ap").alias("map"))


def _mean_f1(pairs: DataFrame, *bars: float) -> DataFrame:
    return frame_f1(pairs, *bars).groupBy("run_id").agg(F.avg("f1").alias("score"))


@register_metric("Detect", "placement")
def placement(gt: DataFrame, pred: DataFrame, params: dict | None = None) -> DataFrame:
    """Mean over frames of the F1 at 0.3 and 0.5; one assignment serves both bars."""
    return _mean_f1(optimal_pairs(gt, pred), 0.3, 0.5)


@register_metric("Detect", "count")
def count_f1(gt: DataFrame, pred: DataFrame, params: dict | None = None) -> DataFrame:
    return _mean_f1(optimal_pairs(gt, pred), 0.3)


@register_metric("Detect", "label")
def label_f1(gt: DataFrame, pred: DataFrame, params: dict | None = None) -> DataFrame:
    return _mean_f1(optimal_pairs(gt, pred, strict=True), 0.3, 0.5)


def team_f1(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(run_id, score): cls is the colour of truth players and team1 or team2 of predictions; the better of both mappings
    of teams to the two most frequent truth colours of a frame (ties: seen first) counts."""
    seen = gt.groupBy("run_id", "frame", "cls").agg(F.count("*").alias("n"), F.min("det_ord").alias("o"))
    w = Window.partitionBy("run_id", "frame").orderBy(F.desc("n"), "o")
    top = seen.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("run_id", "frame").agg(F.max(F.when(F.col("k") == 1, F.col("cls"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("cls"))).alias("b"))
    two = pred.join(top, ["run_id", "frame"], "left").withColumns({"a": F.coalesce("a", F.lit("other")), "b": F.coalesce("b", F.lit("other"))})
    best = []
    for first, second in (("a", "b"), ("b", "a")):
        named = two.withColumn("cls", F.when(F.col("cls") == "team1", F.col(first)).when(F.col("cls") == "team2", F.col(second)).otherwise("other")).drop("a", "b")
        best.append(frame_f1(optimal_pairs(gt, named, strict=True), 0.3, 0.5))
    both = best[0].join(best[1].withColumnRenamed("f1", "g1"), ["run_id", "frame"])
    return both.groupBy("run_id").agg(F.avg(F.greatest("f1", "g1")).alias("score"))


def role_score(label: DataFrame, team: DataFrame) -> DataFrame:
    return label.join(team.withColumnRenamed("score", "t"), "run_id").select("run_id", ((F.col("score") + F.col("t")) / 2).alias("score"))


def smoothness(boxes: DataFrame, keys: tuple[str, ...] = ("run_id",), width: int = 960, height: int = 540) -> DataFrame:
    """(keys, score): mean set IoU of consecutive appearances / (1 + mean |change|); fewer than two IoUs: 0."""
    w = Window.partitionBy(*keys).orderBy("frame")
    frames = boxes.select(*keys, "frame").distinct().withColumn("nxt", F.lead("frame").over(w))
    now = boxes.join(frames.where("nxt is not null"), [*keys, "frame"]).select(*keys, "frame", *BOX)
    after = boxes.join(frames.where("nxt is not null").select(*keys, F.col("frame").alias("f"), F.col("nxt").alias("frame")), [*keys, "frame"]).select(*keys, F.col("f").alias("frame"), *BOX)
    ious = set_iou(now, after, (*keys, "frame"))
    step = ious.withColumn("d", F.abs(F.col("iou") - F.lag("iou").over(w)))
    out = step.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("iou").alias("m"), F.avg("d").alias("d"))
    return boxes.select(*keys).distinct().join(out, list(keys), "left").select(*keys, F.when(F.col("n") >= 2, F.col("m") / (1 + F.col("d"))).otherwise(0.0).alias("score"))


def smoothness_per_type(boxes: DataFrame) -> DataFrame:
    """Mean over labels; a label's consecutive frames are those where it appears."""
    return smoothness(boxes, ("run_id", "cls")).groupBy("run_id").agg(F.avg("score").alias("score"))


def stable_frames(boxes: DataFrame, least: float = 0.7) -> DataFrame:
    """(run_id, frame) of the first frame, and of frames whose predecessor frame - 1 exists with a set IoU of `least`."""
    shifted = boxes.select("run_id", (F.col("frame") + 1).alias("frame"), *BOX)
    frames = boxes.select("run_id", "frame").distinct()
    near = frames.join(shifted.select("run_id", "frame").distinct(), ["run_id", "frame"], "left_semi")
    pick = lambda df: df.join(near, ["run_id", "frame"], "left_semi")
    good = set_iou(pick(boxes), pick(shifted), ("run_id", "frame")).where(F.col("iou") >= least).select("run_id", "frame")
    return frames.groupBy("run_id").agg(F.min("frame").alias("frame")).union(good).distinct()


def element_scores(pillars: DataFrame, weights: DataFrame, manifest: DataFrame, gate: Column | None = None) -> DataFrame:
    """(element_id, run_id, score, weighted, paid): pillar rows (element_id, run_id, pillar, score) against weights (element_id, pillar, weight).

    gate: a condition on the result's columns under which the economic score is paid.
    """
    both = pillars.join(weights, ["element_id", "pillar"], "left")
    known = both.withColumn("weight", F.when(F.col("weight").isNull(), F.raise_error(F.concat(F.lit("no weight for pillar "), "pillar")).cast("double")).otherwise(F.col("weight")))
    rows = known.groupBy("element_id", "run_id").agg(F.sum("score").alias("score"), F.sum(F.col("score") * F.col("weight")).alias("weighted"))
    out = rows.join(F.broadcast(manifest.select("element_id", "theta", "delta_floor", "beta")), "element_id")
    paid = economic_score(F.col("weighted"), F.col("theta"), F.col("delta_floor"), F.col("beta"))
    return out.withColumn("paid", F.when(gate, paid).otherwise(0.0) if gate is not None else paid).drop("theta", "delta_floor", "beta")
