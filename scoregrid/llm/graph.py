"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

BATCH = 500_000


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node that links reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of up to BATCH rows at a time become stars around their smallest node."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[union_find(at[: len(a)], at[len(a) :], len(nodes))]
        far = root != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= BATCH:
            yield stars()
            held.clear()
    if held:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b); nodes without links are absent.

    Rounds of stars inside bounded batches, then the large-star and small-star joins, until no link changes. As soon
    as the links that are left fit one batch (their number is counted), one pass over them ends the work.
    Minima are pre-aggregated and hot nodes are split by skew joins, so no node's links meet in one task.
    """
    schema = "a bigint, b bigint"
    e = links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b")
    e, last = stash(e.mapInArrow(_forest, schema).distinct()), None
    while True:
        state = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if state["n"] == 0 or (state["n"], state["x"]) == last:
            break
        if state["n"] < BATCH:
            old, e = e, stash(e.coalesce(1).mapInArrow(_forest, schema))
            discard(old)
            break
        last = (state["n"], state["x"])
        both = e.union(e.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.selectExpr("b a", "m b").union(least.selectExpr("a", "m b")).where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
        old, e = e, stash(small.mapInArrow(_forest, schema).distinct())
        discard(old)
    out = stash(e.selectExpr("a node", "b component").union(e.select("b").distinct().selectExpr("b node", "b component")))
    discard(e)
    return out
