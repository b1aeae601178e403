"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct five-word shingles. Two documents link when 100 * |A n B| >= 75 * |A u B|.

Method: the shingles of a set are hashed into GROUPS groups and the group counts are its point. For two points the
sum of coordinate minima bounds the overlap from above, and for two R-tree rectangles the same sum over their upper
corners bounds it for all pairs below them. One tree over a whole corpus cannot prune (in 128 dimensions every
rectangle of the upper levels meets every other), so the corpus is first dealt into blocks: a set enters the block
of each of its rarest shingles, as many as any partner must share one of (|A| - ceil(0.75 |A|) + 1). Inside a block
an R-tree finds the pairs whose bound allows a link; those are verified on the exact sets. Nothing is sampled or capped.

Skew: equal sets become one node; sets that hold over a thousandth of the rows leave their copies out of the
blocks; shingles in overfull cells of the count sketch are salted; a first round links each block's sets to the
smallest one of their size band, so that later rounds skip pairs that are already together; larger blocks are
split into pairs of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, mix, shingles, span_hashes, stash, text_chunks, word_spans
from .graph import components

GROUPS, CELL_BITS, CELL_ROWS, BLOOM_BITS = 1024, 20, 256, 26
LEAF, FAN, PART = 32, 8, 4096


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for bounded runs of rows."""
    for row, buf, offs in text_chunks(column):
        low = LOWER[buf]
        s, e, first = word_spans(low, offs)
        h, at = shingles(span_hashes(low, s, e), first, size)
        yield row, [np.unique(h[at[i] : at[i + 1]]) for i in range(len(offs) - 1)]


def _vector(u: np.ndarray) -> np.ndarray:
    """Group counts; a set of over 254 shingles in a group keeps 255 there, which stands for no bound (see _minima)."""
    return np.minimum(np.bincount((u >> np.uint64(54)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


def _minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima, row by row; where both counts are cut off at 255 they may be any number."""
    low = np.minimum(a, b)
    total = low.sum(1, dtype=np.int64)
    return np.where((low == 255).any(1), np.int64(1) << 40, total)


def set_id(u: np.ndarray) -> np.int64:
    """64 bits that stand for a sorted set of hashes."""
    with np.errstate(over="ignore"):
        return _signed(mix(np.array([np.bitwise_xor.reduce(u) + np.uint64(3) * u.sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)))[0]


def _signed(u: np.ndarray) -> np.ndarray:
    return u.astype(np.uint64).view(np.int64)


POINTS = "id bigint, n bigint, set_id bigint, vec binary, cell int, payload binary"


def _points(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            for row, sets in sets_of(b.column(1), size):
                n = np.array([len(u) for u in sets], np.int64)
                for u in sets:
                    np.add.at(cells, ((u >> np.uint64(20)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64), 1)
                ids = np.array([set_id(u) for u in sets], np.int64)
                vec = pa.array([_vector(u).tobytes() for u in sets], pa.binary())
                none = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(sets)), pa.array(n), pa.array(ids), vec, pa.nulls(len(sets), pa.int32()), none], ["id", "n", "set_id", "vec", "cell", "payload"])
        if cells.any():
            k = CELL_ROWS
            part = cells.reshape(k, -1)
            task = pa.array(np.full(k, TaskContext.get().partitionId(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), task, pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), pa.array([x.astype(np.uint32).tobytes() for x in part], pa.binary())], ["id", "n", "set_id", "vec", "cell", "payload"])

    return run


def _add_cells(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64 if len(x.as_buffer()) == 8 * (1 << CELL_BITS) // CELL_ROWS else np.uint32).astype(np.int64) for x in t["payload"].combine_chunks())
    return pa.table({"cell": t["cell"][:1], "payload": pa.array([total.tobytes()], pa.binary())})


def _cells(points: DataFrame) -> np.ndarray:
    """The count sketch of all tasks: added in two levels, so that a group takes about the square root of their number of rows."""
    parts = points.where("cell is not null").select("cell", "n", "payload")
    side = int(np.sqrt(parts.where("cell = 0").count())) + 1
    first = parts.withColumn("part", F.expr(f"pmod(n, {side})")).groupBy("cell", "part").applyInArrow(_add_cells, "cell int, payload binary")
    out = np.zeros((CELL_ROWS, (1 << CELL_BITS) // CELL_ROWS), np.int64)
    for r in first.groupBy("cell").applyInArrow(_add_cells, "cell int, payload binary").collect():  # CELL_ROWS rows, 8 MB
        out[r["cell"]] = np.frombuffer(r["payload"], np.int64)
    return out.ravel()


def _prefixes(size: int, percent: int, order: np.ndarray, heavy_cell: np.ndarray, heavy: dict[int, int]):
    """Each set's rarest shingles (by the sketch, ties by hash): any partner has one of them among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for row, sets in sets_of(b.column(1), size):
                token, who, count, hot = [], [], [], []
                for i, u in enumerate(sets):
                    n = len(u)
                    if not n:
                        continue
                    sid = set_id(u)
                    if sid in heavy and heavy[sid] != ids[row + i].as_py():
                        continue
                    cell = ((u >> np.uint64(20)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)
                    p = n - -(-percent * n // 100) + 1
                    pick = np.argsort(order[cell], kind="stable")[:p]
                    token.append(u[pick])
                    hot.append(heavy_cell[cell[pick]])
                    who.append(np.full(p, sid))
                    count.append(np.full(p, n, np.int64))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(token))), pa.array(np.concatenate(who)), pa.array(np.concatenate(count)), pa.array(np.concatenate(hot))], ["token", "set_id", "n", "hot"])

    return run


def _bounded(percent: int):
    """Keeps pairs whose summed coordinate minima allow the needed overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            va, vb = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, GROUPS) for k in (4, 5))
            most = _minima(va, vb)
            need = b.column(2).to_numpy() + b.column(3).to_numpy()
            keep = (100 + percent) * most >= percent * need
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def rtree_pairs(n: np.ndarray, vec: np.ndarray, group: np.ndarray, percent: int, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of different groups whose bound allows a link, by descending an R-tree against itself.

    split: 0 or 1 for each point; only pairs across the two values are wanted (None: all).
    """
    order = np.lexsort((vec.argmax(1), n, group))
    n, vec, group = n[order], vec[order], group[order]
    levels = []
    start = np.arange(0, len(n), LEAF)
    hi, lo_n, hi_n = np.maximum.reduceat(vec, start), np.minimum.reduceat(n, start), np.maximum.reduceat(n, start)
    lo_g, hi_g = np.minimum.reduceat(group, start), np.maximum.reduceat(group, start)
    levels.append((hi, lo_n, hi_n, lo_g, hi_g))
    while len(levels[-1][1]) > FAN:
        hi, lo_n, hi_n, lo_g, hi_g = levels[-1]
        start = np.arange(0, len(lo_n), FAN)
        levels.append((np.maximum.reduceat(hi, start), np.minimum.reduceat(lo_n, start), np.maximum.reduceat(hi_n, start), np.minimum.reduceat(lo_g, start), np.maximum.reduceat(hi_g, start)))

    def allowed(level: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hi, lo_n, hi_n, lo_g, hi_g = level
        ok = ~((lo_g[a] == hi_g[b]) & (hi_g[a] == lo_g[b]))
        ok &= (100 * hi_n[a] >= percent * lo_n[b]) & (100 * hi_n[b] >= percent * lo_n[a])
        for k in np.array_split(np.flatnonzero(ok), max(1, int(ok.sum()) // 4096)):
            ok[k] = (100 + percent) * _minima(hi[a[k]], hi[b[k]]) >= percent * (lo_n[a[k]] + lo_n[b[k]])
        return ok

    top = np.arange(len(levels[-1][1]))
    a, b = (x.ravel() for x in np.meshgrid(top, top))
    a, b = a[a <= b], b[a <= b]
    for depth in range(len(levels) - 1, -1, -1):
        ok = allowed(levels[depth], a, b)
        a, b = a[ok], b[ok]
        fan, count = (FAN, len(levels[depth - 1][1])) if depth else (LEAF, len(n))
        kids = np.arange(fan)
        out_a, out_b = [], []
        for k in np.array_split(np.arange(len(a)), max(1, len(a) * fan * fan // 1_000_000)):
            x = (a[k, None, None] * fan + kids[None, :, None] + 0 * kids[None, None, :]).ravel()
            y = (b[k, None, None] * fan + kids[None, None, :] + 0 * kids[None, :, None]).ravel()
            ok = (x < count) & (y < count) & ((x <= y) if depth else (x < y))
            x, y = x[ok], y[ok]
            if not depth:
                ok = group[x] != group[y]
                if split is not None:
                    ok &= split[order[x]] != split[order[y]]
                x, y = x[ok], y[ok]
                ok = allowed((vec, n, n, group, group), x, y)
                x, y = x[ok], y[ok]
            out_a.append(x)
            out_b.append(y)
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_a, out_b))
    return order[a], order[b]


def _search(percent: int):
    """Candidate pairs of a block; a task gives a pair once, as long as it remembers (a million pairs)."""
    met: set[tuple[int, int]] = set()

    def run(t: pa.Table) -> pa.Table:
        ids, n, group = t["set_id"].to_numpy(), t["n"].to_numpy(), t["comp"].to_numpy()
        vec = np.frombuffer(b"".join(t["vec"].to_pylist()), np.uint8).reshape(-1, GROUPS)
        c1, c2, mine = (t[k][0].as_py() if k != "chunk" else t[k].to_numpy() for k in ("c1", "c2", "chunk"))
        i, j = rtree_pairs(n, vec, group, percent, None if c1 == c2 else (mine == c1).astype(np.int8))
        x, y = np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])
        new = np.array([p not in met and not met.add(p) for p in zip(x.tolist(), y.tolist(), strict=True)], bool)
        if len(met) > 1_000_000:
            met.clear()
        return pa.table({"a": x[new], "b": y[new]})

    return run


def _verified(percent: int):
    """Exact Jaccard on the sorted sets of each row's two sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(u) + len(v) - both)
            m = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], ["a", "b"])

    return run


def _needed_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the representatives in `needed`; a bit filter of 16 bits for each, at most 8 MB (false hits are joined away), keeps other texts from being shuffled."""
    wide = 1 << int(np.clip(16 * needed.count(), 1 << 13, 1 << BLOOM_BITS) - 1).bit_length()
    bits = F.pmod(F.xxhash64("node"), F.lit(wide))
    words = needed.select(bits.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("v")).toPandas()
    table = np.zeros(wide // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    packed = np.packbits(np.unpackbits(table.view(np.uint8), bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            if not b.num_rows:
                continue
            for row, sets in sets_of(b.column(1), size):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(sets)), pa.array([u.tobytes() for u in sets], pa.binary())], ["node", "shingles"])

    found = docs.where("id is not null").select(F.col("id").alias("node"), "text").withColumn("bit", bits).mapInArrow(run, "node bigint, shingles binary")
    return stash(found.join(needed, "node", "left_semi"))


def _verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b) of representatives."""
    pairs = stash(pairs)
    sets = _needed_sets(docs, pairs.selectExpr("a node").union(pairs.selectExpr("b node")).distinct(), size)
    both = pairs.join(sets.selectExpr("node a", "shingles sa"), "a").join(sets.selectExpr("node b", "shingles sb"), "b")
    links = stash(both.select("a", "b", "sa", "sb").mapInArrow(_verified(percent), "a bigint, b bigint"))
    discard(pairs, sets)
    return links


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id), a row for each input row.

    Null or empty texts: n_shingles 0 and a component of their own. Texts of fewer than `size` words: the whole word
    sequence is the only shingle. Null ids: component_id null. Rows that share an id are one node:
    what any of them links to is reached by all that have words. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    points = stash(docs.mapInArrow(_points(size), POINTS))
    rows = points.where("cell is null").select("id", "n", "set_id", "vec")
    cells = _cells(points)
    nodes = stash(rows.where("n > 0 and id is not null").groupBy("set_id").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("vec").alias("vec"), F.count("*").alias("copies")))
    total = rows.count()
    heavy = {r["set_id"]: r["node"] for r in nodes.where(F.col("copies") > max(100, total // 1000)).select("set_id", "node").collect()}  # at most 1,000
    hot = cells - cells.mean() > max(500, total // 1000)
    order = np.minimum(cells, 65535).astype(np.uint16)

    posts = docs.where("id is not null").mapInArrow(_prefixes(size, percent, order, hot, heavy), "token bigint, set_id bigint, n bigint, hot boolean")
    posts = posts.withColumn("salt", F.expr("if(hot, pmod(xxhash64(set_id), 64), 0)"))
    window = "over (partition by token, salt)"
    shared = posts.withColumn("few", F.expr(f"min(set_id) {window} = max(set_id) {window}")).where("hot or not few")
    shared = stash(shared.select("token", "set_id", "n").distinct())

    # each block's sets against the set of their size band whose rare shingles are shared most, the likely middle of
    # a family of copies; a set tries the one that it meets in most blocks and the one with the largest id (what this misses, the search below finds)
    central = shared.groupBy("set_id").agg(F.count("*").alias("s")).join(nodes.select("set_id", "n"), "set_id").select("set_id", (F.col("s") * 1000 / (F.col("n") + 8)).cast("int").alias("middle"))
    level = F.log(F.col("n").cast("double")) / float(np.log(100 / percent))
    banded = shared.join(central, "set_id").withColumn("band", F.explode(F.array(F.floor(level) * 2, F.floor(level + 0.5) * 2 + 1)))
    pivots = banded.groupBy("token", "band").agg(F.max(F.struct("middle", "set_id")).alias("p"), F.count("*").alias("m")).where("m > 1").selectExpr("token", "band", "p.set_id as b")
    met = banded.join(pivots, ["token", "band"]).where("set_id <> b").groupBy(F.col("set_id").alias("a"), "b").agg(F.count("*").alias("times"))
    near = met.groupBy("a").agg(F.max(F.struct("times", "b")).alias("x"), F.max(F.struct("b", "times")).alias("y"))
    near = near.select("a", F.explode(F.array_distinct(F.array("x.b", "y.b"))).alias("b"))
    at = nodes.select("set_id", "node", "n", "vec")

    def resolve(pairs: DataFrame) -> DataFrame:
        two = pairs.join(at.selectExpr("set_id a", "node na", "n ca", "vec va"), "a").join(at.selectExpr("set_id b", "node nb", "n cb", "vec vb"), "b")
        return two.where(f"100 * least(ca, cb) >= {percent} * greatest(ca, cb)").selectExpr("na", "nb", "ca", "cb", "va", "vb").mapInArrow(_bounded(percent), "a bigint, b bigint")

    first = _verify(docs, resolve(near), size, percent)
    comp = components(first)

    # what is left: pairs of a block that are not together yet
    tagged = shared.join(nodes.selectExpr("set_id", "node"), "set_id").join(comp, "node", "left").selectExpr("token", "set_id", "coalesce(component, node) comp")
    stats = tagged.groupBy("token").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(set_id))").alias("x"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2")
    blocks = stats.groupBy("m", "x").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("m") / PART).alias("k"))
    members = tagged.join(blocks, "token").withColumn("chunk", F.expr("int(pmod(xxhash64(set_id, 7), k))")).join(at, "set_id")
    dealt = members.withColumn("other", F.explode(F.expr("sequence(0, int(k) - 1)"))).selectExpr("token", "least(chunk, other) c1", "greatest(chunk, other) c2", "chunk", "set_id", "n", "comp", "vec")
    left = dealt.groupBy("token", "c1", "c2").applyInArrow(_search(percent), "a bigint, b bigint").distinct()
    left = left.join(at.selectExpr("set_id a", "node na"), "a").join(at.selectExpr("set_id b", "node nb"), "b").selectExpr("na a", "nb b")
    second = _verify(docs, left, size, percent)

    # an id with several sets is one node: its sets' representatives are linked to it
    several = rows.where("n > 0 and id is not null").groupBy("id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo <> hi").select("id")
    own = rows.where("n > 0").select("id", "set_id").join(several, "id").join(nodes.select("set_id", "node"), "set_id").selectExpr("id a", "node b")

    final = components(first.union(second).union(own))
    discard(shared, comp, first, second)
    named = nodes.select("set_id", "node").join(final, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = rows.select("id", "n", "set_id").join(named, "set_id", "left")
    out = stash(out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.expr("if(n = 0 or id is null, id, component)").alias("component_id")))
    discard(points, nodes, final)
    return out
