"""Shapes matched in Arrow batches: against plain sets of pixels, and the cost of their plans."""

import random
import re
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from scoregrid.operators import match as M
from scoregrid.operators import metrics as E
from scoregrid.operators import shapes as P
from scoregrid.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "run_id long, frame long, cls string, det_ord int, score double, x1 long, y1 long, x2 long, y2 long, polygon array<struct<x:long,y:long>>"


def pixels(points):
    near, out, edges = (lambda q: floor(q + Fraction(1, 2))), set(), [(points[i], points[(i + 1) % len(points)]) for i in range(len(points))]
    for a, b in edges:
        steep = abs(b[1] - a[1]) >= abs(b[0] - a[0])
        along, across = (1, 0) if steep else (0, 1)
        a, b = sorted([a, b], key=lambda p: p[along])
        for t in range(a[along], b[along] + 1):
            v = a[across] + (0 if a[along] == b[along] else near(Fraction((t - a[along]) * (b[across] - a[across]), b[along] - a[along])))
            out.add((v, t) if steep else (t, v))
    for y in range(min(p[1] for p in points), max(p[1] for p in points) + 1):
        xs = sorted(near(a[0] + Fraction((y - a[1]) * (b[0] - a[0]), b[1] - a[1])) for a, b in edges if a[1] != b[1] and min(a[1], b[1]) <= y < max(a[1], b[1]))
        out |= {(x, y) for left, right in zip(xs[::2], xs[1::2], strict=True) for x in range(left, right + 1)}
    return {p for p in out if min(p) >= 0}


def value(a, b, empty):
    (xa, ya, xb, yb), (ua, va, ub, vb) = a[5:9], b[5:9]
    if not a[9] and not b[9]:
        w, h = min(xb, ub) - max(xa, ua), min(yb, vb) - max(ya, va)
        both = w * h if w > 0 and h > 0 else 0
        return both / ((xb - xa) * (yb - ya) + (ub - ua) * (vb - va) - both) if both else 0.0
    one, two = (pixels(r[9] or [(r[5], r[6]), (r[7], r[6]), (r[7], r[8]), (r[5], r[8])]) for r in (a, b))
    return len(one & two) / len(one | two) if one | two else empty


def fold(items, others, bar, empty):
    """{place of an item: value} of those that find a free other of their run, frame and class."""
    taken, out = set(), {}
    for i, a in items:
        free = [(value(a, b, empty), -j) for j, b in enumerate(others) if j not in taken and None not in a[:3] and a[:3] == b[:3]]
        if free and max(free)[0] > 0 and max(free)[0] >= bar:
            taken.add(-max(free)[1])
            out[i] = max(free)[0]
    return out


def shapes(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        at = lambda low=-3: rng.randint(low, 13)
        x, y = sorted((at(), at())), sorted((at(), at()))
        points = rng.choice([None, [], [(at(), at()) for _ in range(rng.randint(1, 6))], [(at(), at()) for _ in range(rng.randint(3, 6))], [(-1 - abs(at()), at()) for _ in range(3)]])
        key = (rng.choice([1, 2, None]) if i % 40 == 0 else rng.randint(1, 2), rng.randint(1, 9), rng.choice("ABB") if i % 33 else None)
        out.append((*key, i, rng.choice([0.1, 0.5, 0.5, 0.9, None]), x[0], y[0], x[1] + 1, y[1] + 1, points))
    return out


@pytest.fixture(scope="module")
def two(spark):
    g, p = shapes(150, 1), shapes(170, 2)
    return g, p, spark.createDataFrame(g, COLUMNS).drop("score"), spark.createDataFrame(p, COLUMNS).repartition(3)


def test_greedy_shapes_against_pixels(two):
    g, p, gt, pred = two
    order = sorted(range(len(p)), key=lambda i: (p[i][4] is not None, -(p[i][4] or 0), p[i][3]))
    want = fold([(p[i][3], p[i]) for i in order], g, 0.3, 1.0)
    got = {r["det_ord"]: r["tp"] for r in M.greedy_match(gt, pred, 0.3).collect()}
    assert got == {r[3]: r[3] in want for r in p} and any(got.values())


def test_projected_shapes_against_the_joined_ones(two):
    g, p, gt, pred = two
    rows = lambda df: sorted(map(tuple, df.select("det_ord", "tp").collect()))
    assert rows(P.greedy_shapes(P.united(gt, pred), M.shape_bar(0.3), projected=True)) == rows(M.greedy_match(M.project_shapes(gt, pred), pred, 0.3))


def test_compared_shapes_against_pixels(two):
    g, p, gt, pred = two
    found = fold([(r[3], r) for r in g], p, 0.0, 0.0)
    for got in (M.compare_outputs(gt, pred), M.compare_shapes(P.united(gt, pred))):
        rows = {(r["run_id"], r["frame"]): (r["n_expected"], r["n_actual"], r["matched"], round(r["matched_iou"], 9)) for r in got.collect()}
        keys = {r[:2] for r in g if None not in r[:2]} & {r[:2] for r in p}
        own = lambda k: [found[r[3]] for r in g if r[:2] == k and r[3] in found]
        assert rows == {k: (sum(r[:2] == k for r in g), sum(r[:2] == k for r in p), len(own(k)), round(sum(own(k)), 9)) for k in keys}


@pytest.mark.parametrize(("rows", "work"), [(1, 10**9), (50, 7), (10**9, 1)])
def test_pieces_of_any_size_give_the_same_match(two, monkeypatch, rows, work):
    """Frames are cut from batches, and the pairs of one group from each other, without changing a choice."""
    _, _, gt, pred = two
    t = P._by_frame(P.united(gt, pred), F.col("second"), F.lit(0.3), None, F.when(F.col("second"), -F.col("score")).otherwise(0.0)).toArrow()

    def hits():
        return [h for part in P._whole_frames(iter(t.to_batches(max_chunksize=13))) for h in P._Match(part, 1.0, False).hit.tolist()]

    want = hits()
    monkeypatch.setattr(P, "ROWS", rows)
    monkeypatch.setattr(P, "WORK", work)
    assert hits() == want and len(want) == t.num_rows


def test_ends_of_spans_beyond_the_key():
    line, b = P.np.array([0, 0, 1, 1, 2]), P.np.array([5, 3, 2**61, 7, 1])
    assert P._farthest(line, b).tolist() == [5, 5, 2**61, 2**61, 1]
    assert P._farthest(line, b % 100).tolist() == [5, 5, 2**61 % 100, 2**61 % 100, 1]


def test_report_of_one_pass(two):
    _, _, gt, pred = two
    pred, gt = pred.na.fill({"score": 0.7, "run_id": 1, "cls": "B"}), gt.na.fill({"run_id": 1, "cls": "B"})
    one = E.class_report_of(P.greedy_shapes(P.united(gt, pred), M.shape_bar(0.3), count_truth=True))
    old = E.per_class_report(M.greedy_match(gt, pred, 0.3), gt).where("n_gt > 0")
    rows = lambda df: sorted((r["run_id"], r["cls"], r["n_gt"], r["tp"], round(r["ap"], 9)) for r in df.collect())
    assert rows(one) == rows(old) and rows(one)


@pytest.mark.parametrize(("name", "shuffles"), [("shape_matches", 1), ("shape_output_comparison", 1), ("shape_average_precision", 2)])
def test_tables_are_read_and_dealt_once(spark, name, shuffles):
    """Masks and outlines are made after the shuffle; before, each side was read and dealt by itself, and dealt again with its masks."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == shuffles
    assert plan.count("FileScan parquet") == 1
    assert "array(struct" not in plan[plan.index("Window [row_number") :]
