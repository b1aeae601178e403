"""Scalar expressions: keys, windows, scores, labels, geometry, tolerance scoring, hashes."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS_PER_DAY = 7200


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0.0 where d is null or not positive."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


# keys and windows


def block_from_key(key: Column | str, bare: bool = False) -> Column:
    """Block before the first `-` of the file name; bare: also `<block>.json`. Anything else is null."""
    name = F.element_at(F.split(col(key), "/"), -1)
    head = F.split_part(name, F.lit("-"), F.lit(1))
    if bare:
        head = F.regexp_replace(head, r"\.json$", "")
    return F.when(head.rlike(r"^\d{1,18}$"), head).try_cast("bigint")


def parse_key(key: Column | str, root: str) -> Column:
    """struct(element, miner, commit) of a key below `root`; commit -1 in the layout without it; ('', '', -1) if malformed."""
    parts = F.split(col(key), "/")
    at = F.array_position(parts, root).cast("int")
    element, miner, third = (F.get(parts, at + i) for i in range(3))
    number = F.when(third.rlike(r"^\d{1,18}$"), third).try_cast("bigint")
    good = (at > 0) & element.isNotNull() & miner.isNotNull() & (element != "") & (miner != "") & third.isNotNull()
    return F.struct(F.when(good, element).otherwise("").alias("element"), F.when(good, miner).otherwise("").alias("miner"), F.when(good, F.coalesce(number, F.lit(-1).cast("bigint"))).otherwise(F.lit(-1).cast("bigint")).alias("commit"))


def safe_element_id(element: Column | str) -> Column:
    """Trimmed, `/` as `_`, empty as null."""
    return F.nullif(F.replace(F.trim(col(element)), F.lit("/"), F.lit("_")), F.lit(""))


def lane_index(url: Column | str, lane: Column) -> Column:
    """The private lane's index stands beside the public one."""
    return F.when(lane == "private", F.regexp_replace(col(url), r"index\.json$", "indexprivate.json")).otherwise(col(url))


def resolve_key(index_url: Column, key: Column, root: str) -> Column:
    """Absolute address of a key: http keys stay, keys of the root or with a leading slash hang at the host, others beside the index, without spaces around and "./" before them."""
    key = F.trim(key)
    key = F.when(key.startswith("./"), F.regexp_replace(key, r"^(\./)+", "")).otherwise(key)
    host = F.regexp_extract(index_url, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(index_url, r"[^/]*$", "")
    return F.when(key.rlike("^https?://"), key).when(key.startswith("/"), F.concat(host, key)).when(key.startswith(f"{root}/"), F.concat(host, F.lit("/"), key)).otherwise(F.concat(folder, key))


def window_start(block: Column | str, tempo: int) -> Column:
    return F.floor(col(block) / tempo) * tempo


def window_id(block: Column | str, tempo: int) -> Column:
    return F.concat(F.lit("block-"), window_start(block, tempo).cast("string"))


def window_start_of_id(name: Column | str) -> Column:
    return F.regexp_extract(col(name), r"^block-(\d+)$", 1).try_cast("bigint")


def is_window_active(block: Column, start: Column, expiry: Column) -> Column:
    """Inside [start, expiry]; a null bound is open."""
    return (start.isNull() | (block >= start)) & (expiry.isNull() | (block <= expiry))


def days_to_blocks(days: Column | str) -> Column:
    d = col(days).try_cast("double")
    return F.when(d > 0, F.greatest(F.lit(1), (d * BLOCKS_PER_DAY).cast("bigint")))


def first_truthy(*candidates: Column) -> Column:
    """The first candidate that is neither null, an empty text, a false flag nor the number zero; as trimmed text, null where that is empty.

    A text "0" counts, and so does a blank one: it is chosen and then gives null.
    """
    chosen = [F.when(F.when(F.typeof(c) == "string", c.cast("string") != "").when(F.typeof(c) == "boolean", c.cast("string") == "true").otherwise(c.cast("string").try_cast("double") != 0), c.cast("string")) for c in candidates]
    return F.nullif(F.regexp_replace(F.coalesce(*chosen), r"^\s+|\s+$", ""), F.lit(""))


# Where a record names its challenge, in the order in which the places are tried.
CHALLENGE_PATHS = ["$.meta.task_id", "$.task_id", "$.telemetry.task_id", "$.meta.challenge_id", "$.challenge_id", "$.telemetry.challenge_id", "$.job_id", "$.telemetry.job_id"]


def challenge_id(payload: Column) -> Column:
    """The challenge of a payload (JSON text): the first of CHALLENGE_PATHS that holds something (see first_truthy); null for what is no JSON."""
    record = F.try_parse_json(payload)

    def held(path: str) -> Column:
        v = F.try_variant_get(record, path, "variant")
        kind, text = F.schema_of_variant(v), F.try_variant_get(record, path, "string")
        return F.when(F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(kind == "VOID", F.lit(False)).otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True))), text)

    return F.nullif(F.regexp_replace(F.coalesce(*[held(p) for p in CHALLENGE_PATHS]), r"^\s+|\s+$", ""), F.lit(""))


def sample_block(*values: Column) -> Column:
    """The first value that is a whole number: a payload's block, its telemetry's, its line's."""
    text = [F.regexp_replace(v.cast("string"), r"^\s+|\s+$", "") for v in values]
    return F.coalesce(*[F.when(t.rlike(r"^[+-]?\d{1,18}(\.\d*)?$"), F.regexp_replace(t, r"\..*$", "")).try_cast("bigint") for t in text])


def sample_commit(root: str, *keys: Column) -> Column:
    """The commit of the first key, path or url that names one (zero or more)."""
    found = [parse_key(k, root)["commit"] for k in keys]
    return F.coalesce(*[F.when(c >= 0, c) for c in found])


def element_in_key(key: Column | str, root: str, element: Column | str) -> Column:
    """Whether a key or address lies below an element's folder of the root."""
    return F.contains(F.concat(F.lit("/"), F.regexp_replace(col(key), r"^/|[?#].*$", "")), F.concat(F.lit(f"/{root}/"), safe_element_id(element), F.lit("/")))


# scores


def rtf(p95_ms: Column | str, fps: Column | int = 5, divisor: float = 10000.0) -> Column:
    """Real-time factor (p95 / divisor) * (fps / 5)."""
    return col(p95_ms) / divisor * ((fps if isinstance(fps, Column) else F.lit(fps)) / 5)


def rtf_gate(p95_ms: Column | str, fps: Column, limit: float = 1.0) -> Column:
    """True within the limit; a missing rate skips the gate."""
    return F.when(fps.isNull(), F.lit(True)).otherwise(rtf(p95_ms, fps) <= limit)


def economic_score(score: Column, theta: Column, floor: Column, beta: Column) -> Column:
    """beta * max(max(score - theta, 0), floor): the floor is paid below the baseline too."""
    return beta * F.greatest(F.greatest(score - theta, F.lit(0.0)), floor)


def element_category(element: Column | str, prefixes: list[str], strict: bool = True) -> Column:
    """The first prefix, in the given order, that the text after the last `/` begins with; none is an error (strict) or null."""
    name = F.element_at(F.split(col(element), "/"), -1)
    unknown = F.raise_error(F.concat(F.lit("unknown element: "), F.coalesce(col(element), F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.coalesce(*[F.when(name.startswith(p), F.lit(p)) for p in prefixes], unknown)


def adaptive_delta(theta: Column, default: float, low: float = 0.04, high: float = 0.175) -> Column:
    """low + (high - low) * theta for theta cut to 0..1; the default where theta is null or not a number."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), theta))
    return F.when(theta.isNull() | F.isnan(theta), F.lit(default)).otherwise(low + (high - low) * t)


def match_percentage(a: Column, b: Column) -> Column:
    """1 if both are 0, 0 if one is, else 1 - |a - b| / max(|a|, |b|), at least 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / top))


def scores_match_absolute(a: Column, b: Column, threshold: float) -> Column:
    """Differences up to 1 - threshold match; that bound is taken in decimals, so that 0.8 allows 0.2 itself."""
    return F.abs(a - b) <= float(1 - Decimal(str(threshold)))


# labels


def normalize_label(label: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(col(label), F.lit(""))))


def normalize_team(raw: Column | str) -> Column:
    """Names of the first team are white, of the second black, colour names stay, the rest is null."""
    t = F.lower(F.trim(col(raw).cast("string")))
    return F.when(t.isin("team1", "team_1", "team-1", "1", "0"), "white").when(t.isin("team2", "team_2", "team-2", "2"), "black").when(t.isin("white", "black", "blue", "red", "yellow", "green", "other"), t)


def safe_confidence(score: Column, confidence: Column) -> Column:
    """score, else confidence; 1.0 where that is no finite number."""
    v = F.coalesce(score.cast("string"), confidence.cast("string")).try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 1.0).otherwise(v)


# geometry


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of structs (x1, y1, x2, y2); 0 without overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = (w * h).cast("double")
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(ratio(both, area(a) + area(b) - both))


ANCHORS = [(0.0005, 0.30), (0.01, 0.50), (0.05, 0.50), (0.25, 0.70)]  # fixed values: area ratio and bar


def adaptive_iou_bar(box: Column, width: int = 960, height: int = 540) -> Column:
    """IoU bar by the box's part of the image: linear in the logarithm between the anchors, constant outside."""
    r = area(box) / float(width * height)
    steps = [F.when(r <= ANCHORS[0][0], ANCHORS[0][1])]
    for (r0, t0), (r1, t1) in zip(ANCHORS, ANCHORS[1:], strict=False):
        part = (F.log10(r) - F.log10(F.lit(r0))) / (F.log10(F.lit(r1)) - F.log10(F.lit(r0)))
        steps.append(F.when((r > r0) & (r <= r1), t0 + (t1 - t0) * part))
    return F.coalesce(*steps, F.lit(ANCHORS[-1][1]))


def is_bowtie(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """A quadrilateral crosses itself if opposite edges do. A corner on another edge's line counts as lying on its not-left side."""

    def left(a, b, c):
        return (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])

    def cross(a, b, c, d):
        return (left(a, c, d) != left(b, c, d)) & (left(a, b, c) != left(a, b, d))

    p = [(x1, y1), (x2, y2), (x3, y3), (x4, y4)]
    return cross(p[0], p[1], p[2], p[3]) | cross(p[1], p[2], p[3], p[0])


def keypoint_screen(points: Column, width: int = 960, height: int = 540) -> Column:
    """struct(points, n, ok): points outside the frame become (0, 0); ok: four or more are left, spread over at most twice the frame."""
    inside = lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] < width) & (p["y"] < height)
    kept = F.transform(points, lambda p: F.struct(F.when(inside(p), p["x"]).otherwise(0).alias("x"), F.when(inside(p), p["y"]).otherwise(0).alias("y")))
    live = F.filter(kept, lambda p: (p["x"] != 0) | (p["y"] != 0))
    span = lambda k: F.array_max(F.transform(live, lambda p: p[k])) - F.array_min(F.transform(live, lambda p: p[k]))
    n = F.size(live)
    return F.struct(kept.alias("points"), n.alias("n"), ((n >= 4) & (F.coalesce(span("x"), F.lit(0)) <= 2 * width) & (F.coalesce(span("y"), F.lit(0)) <= 2 * height)).alias("ok"))


def near_edges(p: Column, width: int = 960, height: int = 540, within: int = 50) -> Column:
    """The image borders that lie at most `within` pixels from a point, as an array of names."""
    named = [("left", p["x"] <= within), ("right", p["x"] >= width - within), ("top", p["y"] <= within), ("bottom", p["y"] >= height - within)]
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in named]), lambda n: n.isNotNull())


def same_edge_pairs(points: Column, pairs: list[tuple[int, int]], width: int = 960, height: int = 540, within: int = 100) -> Column:
    """The pairs (places from 1) of live points of which both lie near one border, as an array of their numbers in `pairs`."""
    point = lambda i: F.get(points, F.lit(i - 1))
    live = lambda p: (p["x"] != 0) | (p["y"] != 0)
    hit = [F.when(live(point(a)) & live(point(b)) & F.arrays_overlap(near_edges(point(a), width, height, within), near_edges(point(b), width, height, within)), F.lit(k)) for k, (a, b) in enumerate(pairs)]
    return F.filter(F.array(*hit), lambda k: k.isNotNull())


def set_key(places: Column) -> Column:
    """One number for a set of small numbers, whatever their order."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(places)), ","))


def live_places(points: Column) -> Column:
    """The places, from 1, of points that are not (0, 0)."""
    return F.filter(F.transform(points, lambda p, i: F.when((p["x"] != 0) | (p["y"] != 0), i + 1)), lambda i: i.isNotNull())


# tolerance scoring


def time_decay(dt: Column, tolerance: Column, least_score: Column) -> Column:
    """0 beyond the tolerance, else 1 - dt / tolerance * (1 - least)."""
    return F.when(dt > tolerance, 0.0).otherwise(1 - dt / tolerance * (1 - least_score))


def canonical_text(v: Column) -> Column:
    """Trimmed, lower-case, single spaces; numbers without trailing zeros."""
    t = F.lower(F.trim(F.regexp_replace(v.cast("string"), r"\s+", " ")))
    plain = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"(\.\d*?)0+$", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.$", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(t.rlike(r"^[+-]?\d+(\.\d*)?$"), F.when(plain == "-0", "0").otherwise(plain)).otherwise(t)


def exact_match(p: Column, a: Column) -> Column:
    return F.when(p.isNull() | a.isNull(), 0.0).when(canonical_text(p) == canonical_text(a), 1.0).otherwise(0.0)


def numeric_match(p: Column, a: Column, tolerance: float) -> Column:
    """1 - distance / tolerance inside an open tolerance; equality only where the tolerance is 0."""
    d = F.abs(p.try_cast("double") - a.try_cast("double"))
    if tolerance <= 0:
        return F.when(d == 0, 1.0).otherwise(0.0)
    return F.when(d.isNull() | (d >= tolerance) | (F.abs(d - tolerance) <= 1e-12), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - d / tolerance))


def floor_grade(v: Column) -> Column:
    """Floor of a number whose floor is 1 to 10, else null."""
    f = F.floor(v.try_cast("double"))
    return F.when(f.between(1, 10), f)


# records


def alias(names: list[str], have: list[str]) -> Column:
    """The first of several names for a field that the table has."""
    return F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))


def action_problem(frame: Column, confidence: Column) -> Column:
    """Why a timed action is invalid; null if it is valid."""
    c = F.coalesce(confidence, F.lit(1.0))
    return F.when(frame.isNull() | (frame < 0), "frame").when((c < 0) | (c > 1), "confidence")


BOX_FIELDS = ["x1", "y1", "x2", "y2", "cls_id"]  # fixed values: what a predicted box must have, in the order of the checks


def prediction_problem(rows: Column) -> Column:
    """What is wrong first with predicted rows (JSON text of an array): a reason with the row's and the item's place, else null.

    A row needs frame_id; boxes and polygons are lists or absent (what is empty, zero or false counts as absent); a box needs BOX_FIELDS, a polygon cls_id and a list of
    points (points, polygon or masks) of two numbers each.
    """
    maps = "array<map<string,string>>"
    listed = lambda t: t.isNull() | t.isin("", "0", "0.0", "false", "{}") | t.startswith("[")
    at = lambda text, *i: F.concat_ws("_", F.lit(text + "_at"), *[x.cast("string") for x in i])
    first = lambda reasons: F.get(F.filter(reasons, lambda x: x.isNotNull()), F.lit(0))

    def box(r: Column, i: Column) -> Column:
        each = F.from_json(F.coalesce(r["boxes"], F.lit("[]")), maps)
        return first(F.transform(each, lambda b, j: F.coalesce(*[F.when(~F.map_contains_key(b, k), at(f"output_box_missing_{k}", i, j)) for k in BOX_FIELDS])))

    def polygon(r: Column, i: Column) -> Column:
        each = F.from_json(F.coalesce(r["polygons"], F.lit("[]")), maps)

        def one(p: Column, j: Column) -> Column:
            points = F.from_json(F.coalesce(F.nullif(p["points"], F.lit("[]")), F.nullif(p["polygon"], F.lit("[]")), F.nullif(p["masks"], F.lit("[]"))), "array<string>")
            bad = first(F.transform(points, lambda q, k: F.when(~q.startswith("[") | (F.coalesce(F.json_array_length(q), F.lit(0)) != 2), at("output_polygon_point_invalid", i, j, k))))
            return F.coalesce(F.when(~F.map_contains_key(p, "cls_id"), at("output_polygon_missing_cls_id", i, j)), F.when(points.isNull() | (F.size(points) == 0), at("output_polygon_points_invalid", i, j)), bad)

        return first(F.transform(each, one))

    def row(r: Column, i: Column) -> Column:
        return F.coalesce(F.when(~F.map_contains_key(r, "frame_id"), at("output_missing_frame_id", i)), F.when(~listed(r["boxes"]), at("output_boxes_invalid", i)), F.when(~listed(r["polygons"]), at("output_polygons_invalid", i)), box(r, i), polygon(r, i))

    return first(F.transform(F.from_json(rows, maps), row))


def public_asset_url(url: Column, private_hosts: list[str], public_host: str) -> Column:
    """Paths of /challenge-objects/ on a private host move to the public one."""
    host = F.try_parse_url(url, F.lit("HOST"))
    path = F.regexp_extract(url, r"^https?://[^/]+(/challenge-objects/[^?#]*)", 1)
    return F.when(host.isin(private_hosts) & (path != ""), F.concat(F.lit(public_host), path)).otherwise(url)


def looks_like_image(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(r"\.(jpe?g|png|webp|bmp|gif)$")


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """An http(s) address whose host is listed or lies below a listed one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(url.rlike("^https?://") & reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in hosts]), F.lit(False))


def frame_id(*names: Column) -> Column:
    """The first of several columns that holds digits only."""
    return F.coalesce(*[F.when(c.cast("string").rlike(r"^\d{1,18}$"), c.cast("string")).try_cast("bigint") for c in names])


def challenge_type_id(raw: Column, names: dict[str, int]) -> Column:
    t = F.lower(F.trim(raw.cast("string")))
    named = reduce(lambda c, kv: F.when(t == kv[0], kv[1]).otherwise(c), names.items(), F.lit(None).cast("int"))
    return F.when(t.rlike(r"^\d{1,9}$"), t.try_cast("int")).otherwise(named)


def record_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON of columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def masked_source_hash(source: Column, names: list[str]) -> Column:
    """SHA-256 of a source text with the values of four assignments blanked."""
    return F.sha2(reduce(lambda c, n: F.regexp_replace(c, rf"(?m)^(\s*{n}\s*=\s*).*$", "$1"), names, source), 256)


def nearest_colour(b: Column, g: Column, r: Column, palette: dict[str, tuple[int, int, int]]) -> Column:
    """Name of the nearest palette entry; ties go to the earlier one."""
    d = lambda c: (b - c[0]) * (b - c[0]) + (g - c[1]) * (g - c[1]) + (r - c[2]) * (r - c[2])
    rows = [F.struct(d(c).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(palette.items())]
    return F.least(*rows)["n"]


def run_gate(success: Column, frames: Column, least_frames: int, expected: Column) -> Column:
    return success & (frames >= least_frames) & ((expected <= 0) | (frames <= expected))


def is_weight_eligible(timed_out: Column) -> Column:
    return ~F.coalesce(timed_out, F.lit(False))


def truth_type(explicit: Column, prediction: Column) -> Column:
    """The given type, else by the keys of a prediction's JSON text: card grades, cricket fields or timed actions."""
    has = lambda k: F.coalesce(prediction.contains(f'"{k}"'), F.lit(False))
    guess = F.when(has("card_grade") | has("subgrade_edges"), "card").when(has("kph") | has("bounce_x"), "cricket").when(has("action"), "actions")
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), guess)
