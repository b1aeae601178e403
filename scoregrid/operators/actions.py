"""Timed actions, tolerance fields and their dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import exact_match, numeric_match, ratio, time_decay
from .match import _fold

# Weight, least score and tolerance in seconds of each action.
ACTIONS = {
    "pass": (1.0, 0.0, 1.0), "pass_received": (1.4, 0.0, 1.0), "recovery": (1.5, 0.0, 1.5), "tackle": (2.5, 0.1, 1.5), "interception": (2.8, 0.5, 2.0),
    "ball_out_of_play": (2.9, 0.5, 2.0), "clearance": (3.1, 0.5, 2.0), "take_on": (3.2, 0.5, 2.0), "substitution": (4.2, 0.5, 2.0), "block": (4.2, 0.5, 2.0),
    "aerial_duel": (4.3, 0.5, 2.0), "shot": (4.7, 0.5, 2.0), "save": (7.3, 0.5, 2.0), "foul": (7.7, 0.5, 2.5), "goal": (10.9, 0.5, 3.0),
}
# Weight and tolerance of each weighted cricket field.
CRICKET = {
    "kph": (0.04, 3.0), "bounce_x": (0.23, 0.25), "stump_y": (0.18, 0.12), "deviation": (0.13, 2.0), "swing_angle": (0.11, 2.0), "stump_z": (0.11, 0.12), "release_y": (0.03, 0.15),
    "release_z": (0.03, 0.15), "bounce_y": (0.03, 0.15), "impact_x": (0.03, 0.25), "impact_y": (0.03, 0.15), "impact_z": (0.03, 0.15), "interception_distance": (0.02, 0.25),
}
CRICKET_EXACT = ("match", "matchid", "inningsid", "overid", "ball_in_over", "ballid", "xlsx_overs", "scorecard_overs", "runs", "wickets")
CARD = {"subgrade_surface": 0.25, "subgrade_edges": 0.25, "subgrade_corners": 0.25, "subgrade_centering": 0.10, "card_grade": 0.15}
CARD_TOLERANCE, FPS = 2.0, 25
SCORERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def _table(name: str, i: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[i])]), F.col(name))


def action_score(gt: DataFrame, pred: DataFrame, key: str = "challenge_id") -> DataFrame:
    """(key, score): predictions in frame order take the free truth of their action that decays least; a miss costs the action's weight.

    The gain, less the misses, over the truth's weight, cut to 0..1. Unknown actions are ignored; without truth 0.
    """
    known = lambda df: df.where(F.col("action").isin(list(ACTIONS)))
    g = known(gt).groupBy(key, "action").agg(F.array_sort(F.collect_list(F.struct("ord", "frame"))).alias("g"))
    p = known(pred).groupBy(key, "action").agg(F.array_sort(F.collect_list(F.struct("frame", "ord"))).alias("p"))
    both = g.join(p, [key, "action"], "full").withColumns({"w": _table("action", 0), "low": _table("action", 1), "tol": _table("action", 2)})
    both = both.withColumns({"g": F.coalesce("g", F.expr("cast(array() as array<struct<ord:bigint,frame:bigint>>)")), "p": F.coalesce("p", F.expr("cast(array() as array<struct<frame:bigint,ord:bigint>>)"))})
    got = _fold(F.col("p"), F.col("g"), lambda p, g: time_decay(F.abs(p["frame"] - g["frame"]) / float(FPS), F.col("tol"), F.col("low")), lambda b: b["v"] > 0)
    rows = both.withColumn("m", got)
    gain = F.aggregate("m", F.lit(0.0), lambda a, x: a + F.when(x["hit"], x["value"]).otherwise(-1.0)) * F.col("w")
    sums = rows.groupBy(key).agg(F.sum(gain).alias("gain"), F.sum(F.size("g") * F.col("w")).alias("total"))
    return sums.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(F.col("gain"), F.col("total")))).alias("score"))


def normalize_pillar_weights(rows: DataFrame) -> DataFrame:
    """(pillar, weight): names trimmed, weights above 0 merged and scaled to 1."""
    good = rows.select(F.trim("pillar").alias("pillar"), "weight").where("pillar <> '' and weight > 0").groupBy("pillar").agg(F.sum("weight").alias("w"))
    return good.select("pillar", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))  # a row for each pillar


def register_pillar_scorer(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    if not name.strip():
        raise ValueError("a pillar needs a name")
    SCORERS[name.strip()] = fn


register_pillar_scorer("soccer_action", action_score)
register_pillar_scorer("private_legacy_score", action_score)


def pillar_mix(gt: DataFrame, pred: DataFrame, weights: dict[str, float], key: str = "challenge_id") -> DataFrame:
    """Sum of normalised weight times pillar score; pillars without a scorer count 0, no weights at all is action_score."""
    good = {k.strip(): sum(v for n, v in weights.items() if n.strip() == k.strip() and v > 0) for k, v in weights.items() if k.strip() and v > 0}
    if not good:
        return action_score(gt, pred, key)
    total = sum(good.values())
    ids = gt.select(key).union(pred.select(key)).distinct().withColumn("score", F.lit(0.0))
    for name, w in sorted(good.items()):
        if name in SCORERS:
            part = SCORERS[name](gt, pred).select(key, F.col("score").alias("_s"))
            ids = ids.join(part, key, "left").select(key, (F.col("score") + F.coalesce("_s", F.lit(0.0)) * (w / total)).alias("score"))
    return ids.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def field_score(df: DataFrame, weights: dict[str, tuple[float, float]], exact: tuple[str, ...] = ()) -> DataFrame:
    """df with s_<field> and score, from columns <field>_pred and <field>_gt; fields that df lacks score 0."""
    have, parts, total = set(df.columns), {}, F.lit(0.0)
    for name, (w, tol) in weights.items():
        if f"{name}_gt" in have and f"{name}_pred" in have:
            parts[f"s_{name}"] = numeric_match(F.col(f"{name}_pred"), F.col(f"{name}_gt"), tol)
            total = total + w * parts[f"s_{name}"]
    for name in exact:
        if f"{name}_gt" in have and f"{name}_pred" in have:
            parts[f"s_{name}"] = exact_match(F.col(f"{name}_pred"), F.col(f"{name}_gt"))
    return df.withColumns(parts | {"score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))})


def cricket_score(df: DataFrame) -> DataFrame:
    return field_score(df, CRICKET, CRICKET_EXACT)


def card_score(df: DataFrame) -> DataFrame:
    return field_score(df, {k: (w, CARD_TOLERANCE) for k, w in CARD.items()})


def sufficient_actions(gt: DataFrame, key: str = "challenge_id", least: int = 3) -> DataFrame:
    return gt.groupBy(key, "action").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def closest_event(gt: DataFrame, keys: tuple[str, ...] = ("challenge_id", "action")) -> DataFrame:
    """(keys, frame, from_frame, to_frame): the frames that are nearest to each truth event, by midpoints."""
    w = Window.partitionBy(*keys).orderBy("frame")
    e = gt.select(*keys, "frame").distinct()
    return e.select(*keys, "frame", F.floor((F.lag("frame").over(w) + F.col("frame")) / 2).alias("from_frame"), F.floor((F.lead("frame").over(w) + F.col("frame")) / 2).alias("to_frame"))


def matched_actions(gt: DataFrame, pred: DataFrame, half: int, key: str = "challenge_id") -> DataFrame:
    """(key, action, frame, confidence, hit): each truth, in frame order, takes the highest free prediction within `half` frames (ties: the earlier one).

    Truth and predictions are cut where more than `half` frames lie between neighbours, so a fold sees one stretch of
    events and never all of a key's. One prediction a frame and action, the last wins.
    """
    acts = F.col("action").isin(list(ACTIONS))
    g = gt.where(acts).select(key, "action", "frame").distinct().withColumn("confidence", F.lit(None).cast("double"))
    p = pred.where(acts).groupBy(key, "action", "frame").agg(F.max_by("confidence", "ord").cast("double").alias("confidence"))
    order = Window.partitionBy(key, "action").orderBy("frame")
    apart = F.coalesce(F.col("frame") - F.lag("frame").over(order) > half, F.lit(True)).cast("int")
    both = g.withColumn("real", F.lit(True)).unionByName(p.withColumn("real", F.lit(False))).withColumn("apart", apart)
    both = both.withColumn("stretch", F.sum("apart").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    one = lambda real: F.array_sort(F.collect_list(F.when(F.col("real") == real, F.struct("frame", "confidence"))))
    met = both.groupBy(key, "action", "stretch").agg(one(True).alias("g"), one(False).alias("p"))
    near = lambda g, p: F.when(F.abs(p["frame"] - g["frame"]) <= half, p["confidence"]).otherwise(-1.0)
    start = F.filter(F.transform("p", lambda x: x["frame"]), lambda x: F.lit(False))

    def take(used: Column, g: Column) -> Column:
        free = F.filter(F.transform("p", lambda p: F.struct(near(g, p).alias("v"), (-p["frame"]).alias("f"))), lambda c: (c["v"] >= 0) & ~F.array_contains(used, -c["f"]))
        return F.transform(F.array(F.array_max(free)), lambda best: F.when(best.isNull(), used).otherwise(F.array_append(used, -best["f"])))[0]

    taken = met.withColumn("used", F.aggregate("g", start, take))
    return taken.select(key, "action", "used", F.explode("p").alias("x")).select(key, "action", "x.frame", "x.confidence", F.array_contains("used", F.col("x.frame")).alias("hit"))


def map_at_1s(gt: DataFrame, pred: DataFrame, key: str = "challenge_id", delta: int = FPS, thresholds: int = 200) -> DataFrame:
    """(key, action, ap) of each action that truth has: 11-point average precision of precision and recall at `thresholds` confidences from 0 to 1.

    Truth meets predictions within delta // 2 frames (matched_actions). A prediction counts up to the last threshold that
    its confidence reaches; sums over falling thresholds are the counts at each, and only thresholds at which they
    change are looked at.
    """
    steps = thresholds - 1
    truth = gt.where(F.col("action").isin(list(ACTIONS))).select(key, "action", "frame").distinct().groupBy(key, "action").agg(F.count("*").alias("n"))
    near = F.floor(F.col("confidence") * steps)
    reach = F.greatest(*[F.when((near + d) / float(steps) <= F.col("confidence"), near + d) for d in (-1, 0, 1)])
    found = matched_actions(gt, pred, delta // 2, key).withColumn("level", F.least(reach, F.lit(steps))).where("level >= 0")
    counts = found.groupBy(key, "action", "level").agg(F.count_if("hit").alias("hits"), F.count("*").alias("seen"))
    falling = Window.partitionBy(key, "action").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # at most `thresholds` rows
    points = counts.withColumns({"hits": F.sum("hits").over(falling), "seen": F.sum("seen").over(falling)}).join(truth, [key, "action"])
    precision, recall = F.col("hits") / F.col("seen"), F.col("hits") / F.col("n")
    best = points.groupBy(key, "action").agg(*[F.max(F.when(recall >= k / 10.0, precision)).alias(f"p{k}") for k in range(11)])
    ap = sum((F.coalesce(f"p{k}", F.lit(0.0)) for k in range(11)), F.lit(0.0)) / 11
    return truth.select(key, "action").join(best, [key, "action"], "left").select(key, "action", ap.alias("ap"))


def mean_map_at_1s(ap: DataFrame, key: str = "challenge_id") -> DataFrame:
    """Mean over all actions, absent ones as 0."""
    return ap.groupBy(key).agg((F.sum("ap") / len(ACTIONS)).alias("map_at_1s"))


def band_join(gt: DataFrame, pred: DataFrame, tolerance: int, key: str = "challenge_id") -> DataFrame:
    """Pairs of one key and action whose frames differ by at most `tolerance`: an equality join on frame buckets, each
    truth shown to its own and both neighbouring buckets, so that no key's events meet all others."""
    width = max(1, tolerance)
    g = gt.select(key, "action", F.col("ord").alias("gt_ord"), F.col("frame").alias("gt_frame")).withColumn("b", F.explode(F.array(*[F.floor(F.col("gt_frame") / width) + k for k in (-1, 0, 1)])))
    p = pred.select(key, "action", F.col("ord").alias("pred_ord"), F.col("frame").alias("pred_frame"), "confidence").withColumn("b", F.floor(F.col("pred_frame") / width))
    return g.join(p, [key, "action", "b"]).where(F.abs(F.col("gt_frame") - F.col("pred_frame")) <= tolerance).drop("b")


def dispatch(rows: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "truth_type") -> DataFrame:
    """Rows of each type through its scorer, which gives (id, score); rows of other types score 0. Needs the column id."""
    out = rows.where(~F.coalesce(F.col(kind).isin(list(scorers)), F.lit(False))).select("id", F.lit(0.0).alias("score"))
    for name, fn in scorers.items():
        out = out.unionByName(fn(rows.where(F.col(kind) == name)).select("id", "score"))
    return out
