"""Integer polygons as pixel masks, in array expressions: a mask is the rows from y0 on, each a list of disjoint spans.

A pixel belongs to a polygon if it lies between a pair of edge crossings of its row (even-odd rule, crossings rounded to the
nearest pixel, both ends included) or on a digital edge: the nearest pixel of each row of a steep edge, of each column of
a flat one. Halves are rounded up. Nothing is painted at negative places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import box_iou

POINTS = "array<struct<x:bigint,y:bigint>>"
MASK = "struct<y0:bigint,rows:array<array<struct<a:bigint,b:bigint>>>,size:bigint>"

# each edge points to larger y (steep) or larger x (flat), so that its pixels do not depend on the direction of travel
_EDGES = """transform(pts, (p, i) -> named_struct('p', p, 'q', pts[(i + 1) % size(pts)],
  'steep', abs(pts[(i + 1) % size(pts)].y - p.y) >= abs(pts[(i + 1) % size(pts)].x - p.x)))"""
_TURNED = "transform(edges, e -> if(if(e.steep, e.p.y > e.q.y, e.p.x > e.q.x), named_struct('p', e.q, 'q', e.p, 'steep', e.steep), e))"
_CROSSINGS = "array_sort(transform(filter(edges, e -> e.p.y <> e.q.y and y >= least(e.p.y, e.q.y) and y < greatest(e.p.y, e.q.y)), e -> floor(e.p.x + (y - e.p.y) * (e.q.x - e.p.x) / (e.q.y - e.p.y) + 0.5)))"
_INSIDE = f"transform(array({_CROSSINGS}), c -> transform(filter(sequence(0, greatest(size(c) - 2, 0)), i -> i % 2 = 0 and i + 1 < size(c)), i -> named_struct('a', c[i], 'b', c[i + 1])))[0]"
_STEEP = "transform(filter(edges, e -> e.steep and y between e.p.y and e.q.y), e -> named_struct('a', e.p.x + if(e.q.y = e.p.y, 0L, floor((y - e.p.y) * (e.q.x - e.p.x) / (e.q.y - e.p.y) + 0.5)), 'b', e.p.x + if(e.q.y = e.p.y, 0L, floor((y - e.p.y) * (e.q.x - e.p.x) / (e.q.y - e.p.y) + 0.5))))"
# columns x of a flat edge with y - 1/2 <= its height < y + 1/2
_RISING = "named_struct('a', greatest(e.p.x, e.p.x + ceil((2 * (y - e.p.y) - 1) * (e.q.x - e.p.x) / (2 * (e.q.y - e.p.y)))), 'b', least(e.q.x, e.p.x + ceil((2 * (y - e.p.y) + 1) * (e.q.x - e.p.x) / (2 * (e.q.y - e.p.y))) - 1))"
_FALLING = "named_struct('a', greatest(e.p.x, e.p.x + floor((2 * (y - e.p.y) + 1) * (e.q.x - e.p.x) / (2 * (e.q.y - e.p.y))) + 1), 'b', least(e.q.x, e.p.x + floor((2 * (y - e.p.y) - 1) * (e.q.x - e.p.x) / (2 * (e.q.y - e.p.y)))))"
_FLAT = f"transform(filter(edges, e -> not e.steep and y between least(e.p.y, e.q.y) and greatest(e.p.y, e.q.y)), e -> case when e.p.y = e.q.y then named_struct('a', e.p.x, 'b', e.q.x) when e.p.y < e.q.y then {_RISING} else {_FALLING} end)"
_SPAN = "array<struct<a:bigint,b:bigint>>"
_MERGED = f"""aggregate(array_sort(filter(transform(cast(concat({_INSIDE}, {_STEEP}, {_FLAT}) as {_SPAN}), s -> named_struct('a', greatest(s.a, 0L), 'b', s.b)), s -> s.b >= s.a)), cast(array() as {_SPAN}),
  (done, s) -> if(size(done) > 0 and s.a <= element_at(done, -1).b + 1, concat(slice(done, 1, size(done) - 1), array(named_struct('a', element_at(done, -1).a, 'b', greatest(element_at(done, -1).b, s.b)))), concat(done, array(s))))"""
_LOW, _HIGH = ("array_{0}(transform(pts, p -> p.y))".format(k) for k in ("min", "max"))
_ROWS = f"transform(sequence(greatest({_LOW}, 0L), greatest({_HIGH}, 0L)), y -> {_MERGED})"
_SIZE = "aggregate(rows, 0L, (n, r) -> n + aggregate(r, 0L, (m, s) -> m + s.b - s.a + 1))"


def _let(name: str, value: str, body: str) -> str:
    """body with a value under a name, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def raster(points: str) -> Column:
    """The mask of a polygon: `points` is the SQL text of an array of structs x, y. Null for null or no points."""
    mask = _let("edges", _EDGES, _let("edges", _TURNED, _let("rows", _ROWS, f"named_struct('y0', greatest({_LOW}, 0L), 'rows', rows, 'size', {_SIZE})")))
    return F.expr(_let("pts", f"cast({points} as {POINTS})", f"if(size(pts) > 0, cast({mask} as {MASK}), null)"))


def box_mask(box: Column) -> Column:
    """The mask of a box's four corners: both edges of it count."""
    low, high = F.greatest(F.least(box["y1"], box["y2"]), F.lit(0)), F.greatest(box["y1"], box["y2"])
    left, right = F.greatest(F.least(box["x1"], box["x2"]), F.lit(0)), F.greatest(box["x1"], box["x2"])
    lines = F.when(right >= left, F.greatest(high - low + 1, F.lit(0))).otherwise(0)
    rows = F.array_repeat(F.array(F.struct(left.alias("a"), right.alias("b"))), lines.cast("int"))
    return F.struct(low.alias("y0"), rows.alias("rows"), (lines * (right - left + 1)).alias("size")).cast(MASK)


def mask_overlap(a: Column, b: Column) -> Column:
    """The number of pixels that two masks share."""
    low = F.greatest(a["y0"], b["y0"])
    high = F.least(a["y0"] + F.size(a["rows"]), b["y0"] + F.size(b["rows"])) - 1
    row = lambda m, y: F.get(m["rows"], (y - m["y0"]).cast("int"))
    zero = F.lit(0).cast("bigint")

    def shared(y: Column) -> Column:
        other = row(b, y)
        return F.aggregate(row(a, y), zero, lambda n, s: n + F.aggregate(other, zero, lambda m, t: m + F.greatest(F.least(s["b"], t["b"]) - F.greatest(s["a"], t["a"]) + 1, zero)))

    return F.when(high < low, zero).otherwise(F.aggregate(F.when(high >= low, F.sequence(low, high)), zero, lambda n, y: n + shared(y)))


def shape_iou(a: Column, b: Column, empty: float = 0.0) -> Column:
    """IoU of shapes (struct of x1, y1, x2, y2 and mask, null for a box): of the boxes if neither has a mask, else of their pixels, a box being its four corners.

    empty: the value of two masks without a pixel.
    """
    def pixels(m: Column, n: Column) -> Column:
        both = mask_overlap(m, n)
        return F.transform(F.array(F.struct(both.alias("both"), (m["size"] + n["size"]).alias("sum"))), lambda t: F.when(t["sum"] > t["both"], t["both"] / (t["sum"] - t["both"])).otherwise(F.lit(empty)))[0]

    drawn = lambda s: F.coalesce(s["mask"], box_mask(s))
    paired = F.transform(F.array(F.struct(drawn(a).alias("m"), drawn(b).alias("n"))), lambda t: pixels(t["m"], t["n"]))[0]
    return F.when(a["mask"].isNull() & b["mask"].isNull(), box_iou(a, b)).otherwise(paired)
