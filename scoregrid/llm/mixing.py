"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The tokens that a sample takes from each cell are raked until every
source, every language and every topic has its target share of the sample, while no cell gives more tokens than it has:
a step that makes a category grow scales only its cells that still have room. A document is then kept with its cell's
calibrated probability (sampled tokens over tokens), decided by a hash of its id.

Topics are clusters of texts: spherical k-means over the hashed words of every document, weighted by inverse document
frequency. Sums are taken over integers, so that the order of tasks changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import CHUNK, LOWER, discard, give_back, span_hashes, stash, text_chunks, word_spans

MARGINS = ("source", "lang", "topic")
LOCAL_CELLS = 200_000  # beyond this many cells the same raking runs as joins
WIDE, UNIT = 512, 1 << 20  # word buckets of a text; a unit vector's length in integer sums
ROUNDS, CLOSE, STALL = 5000, 1e-7, 50  # a raking ends when the largest margin error is CLOSE, or has not shrunk by a hundredth in STALL rounds


def word_counts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, (texts, WIDE) counts of its words of three or more bytes by hash bucket)."""
    low = LOWER[buf]
    s, e, first = word_spans(low, offs)
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    long = e - s >= 3
    bucket = (span_hashes(low, s, e)[long] >> np.uint64(55)).astype(np.int64)
    return np.diff(first), np.bincount(doc[long] * WIDE + bucket, minlength=n * WIDE).astype(np.uint32).reshape(n, WIDE)


@dataclass
class Topics:
    weight: np.ndarray  # inverse document frequency of each bucket
    centres: np.ndarray  # (topics, WIDE) unit vectors; no rows before they are learned

    def unit(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts.astype(np.float32)) * self.weight
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), np.float32(1e-9))

    def of(self, counts: np.ndarray) -> np.ndarray:
        """The topic of each text; -1 for one without a word of three bytes."""
        v = self.unit(counts)
        best = (v @ self.centres.T).argmax(1) if len(self.centres) else np.zeros(len(counts), np.int64)
        return np.where(counts.any(1), best, -1).astype(np.int32)


def _counted(keep: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in text_chunks(b.column(at), CHUNK // 4):
                n, counts = word_counts(buf, offs)
                rest = [b.column(i).slice(row, len(n)) for i in range(len(keep)) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), pa.array([_packed(x) for x in counts], pa.binary())], [*(c for c in keep if c != keep[at]), "n_tokens", "counts"])
        give_back()

    return run


def _packed(counts: np.ndarray) -> bytes:
    """A text's counts in the narrowest whole numbers that hold them; the length tells which."""
    most = counts.max()
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(x) == WIDE for x in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDE)
    return np.stack([np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // WIDE]).astype(np.uint32) for x in rows])


def fit_topics(counted: DataFrame, topics: int = 16, rounds: int = 5) -> Topics:
    """Clusters of all rows of a table with a column counts; the first ones gather texts by their heaviest word bucket."""

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDE + 1, np.int64)
        for b in batches:
            c = _matrix(b.column(0))
            total[:WIDE] += (c > 0).sum(0)
            total[WIDE] += len(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDE + 1)), pa.array(total)], ["bucket", "n"])

    df = np.zeros(WIDE + 1)
    for r in counted.select("counts").mapInArrow(frequency, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # WIDE + 1 rows
        df[r["bucket"]] = r["n"]
    model = Topics(np.log((df[WIDE] + 1) / (df[:WIDE] + 1) + 1).astype(np.float32), np.zeros((0, WIDE), np.float32))
    for turn in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], model: Topics = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((topics, WIDE), np.int64)
            for b in batches:
                c = _matrix(b.column(0))
                c = c[c.any(1)]
                v = model.unit(c)
                own = model.of(c) if len(model.centres) else v.argmax(1) % topics
                whole = np.rint(v * UNIT).astype(np.int64)
                for k in np.unique(own):
                    total[k] += whole[own == k].sum(0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["spot", "n"])

        total = np.zeros(topics * WIDE)
        for r in counted.select("counts").mapInArrow(sums, "spot bigint, n bigint").groupBy("spot").agg(F.sum("n").alias("n")).collect():  # topics * WIDE rows
            total[r["spot"]] = r["n"]
        total = total.reshape(topics, WIDE)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(size > 0, total / np.maximum(size, 1), model.centres if turn else 0.0)
        model = Topics(model.weight, centres.astype(np.float32))
    return model


def with_topics(docs: DataFrame, model: Topics, text_column: str = "text") -> DataFrame:
    """docs with n_tokens (words) and topic; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "topic")]
    docs = docs.select(*keep)
    at = keep.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, offs in text_chunks(b.column(at), CHUNK // 4):
                n, counts = word_counts(buf, offs)
                yield pa.RecordBatch.from_arrays([*(c.slice(row, len(n)) for c in b.columns), pa.array(n.astype(np.int64)), pa.array(model.of(counts))], [*keep, "n_tokens", "topic"])
        give_back()

    return docs.mapInArrow(run, StructType(list(docs.schema)).add("n_tokens", LongType()).add("topic", IntegerType()))


def rake(codes: list[np.ndarray], tokens: np.ndarray, x: np.ndarray, goals: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """(tokens taken from each cell, largest margin error as a part of all tokens): raking from x, never over `tokens`."""
    scale, worst = max(float(tokens.sum()), 1e-300), []
    for _ in range(rounds):
        for code, goal in zip(codes, goals, strict=True):
            now, full = np.bincount(code, x, len(goal)), np.bincount(code, np.where(x >= tokens, x, 0), len(goal))
            grow = goal > now
            room = np.where(grow, now - full, now)
            factor = np.where(room > 0, np.where(grow, goal - full, goal) / np.where(room > 0, room, 1), 1.0)[code]
            x = np.where(grow[code] & (x >= tokens), x, np.minimum(tokens, x * factor))
        worst.append(max(float(np.abs(np.bincount(c, x, len(g)) - g).max(initial=0)) for c, g in zip(codes, goals, strict=True)) / scale)
        if worst[-1] < close or (len(worst) > STALL and worst[-1] > 0.99 * worst[-1 - STALL]):
            break
    return x, worst[-1] if worst else 0.0


def rake_joined(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """rake() as joins over a table (margins, tokens, x), for more cells than the driver should hold; goals[m] has (m, goal). Each round is written to the shared folder."""
    now, worst = cells, []
    scale = max(cells.agg(F.sum("tokens")).first()[0] or 0.0, 1e-300)
    for _ in range(rounds):
        old = now
        for m, goal in goals.items():
            sums = now.groupBy(m).agg(F.sum("x").alias("now"), F.sum(F.expr("if(x >= tokens, x, 0.0D)")).alias("full")).join(goal, m)
            sums = sums.selectExpr(m, "goal > now as grow", "if(goal > now, now - full, now) as room", "if(goal > now, goal - full, goal) as aim")
            factor = sums.selectExpr(m, "grow", "if(room > 0, aim / room, 1.0D) as factor")
            now = now.join(factor, m).withColumn("x", F.expr("if(grow and x >= tokens, x, least(tokens, x * factor))")).select(*cells.columns)
        now = stash(now)
        if old is not cells:
            discard(old)
        gaps = [now.groupBy(m).agg(F.sum("x").alias("now")).join(g, m).agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0 for m, g in goals.items()]
        worst.append(max(gaps) / scale)
        if worst[-1] < close or (len(worst) > STALL and worst[-1] > 0.99 * worst[-1 - STALL]):
            break
    return now, worst[-1] if worst else 0.0


@dataclass
class Mixture:
    """What a sample takes: cells (source, lang, topic, tokens, probability), margins (margin, category, present, target, expected: shares), and the part of all tokens that it holds."""

    cells: DataFrame
    margins: DataFrame
    budget: float
    gap: float  # the largest difference of an expected from its target share, as a part of all tokens
    topics: Topics


def _named(column: str) -> Column:
    """A category's name: a null is one of its own, apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _wanted(given: dict) -> dict:
    return {"null" if k is None else f"={k}": float(v) for k, v in given.items()}


def plan_mixture(docs: DataFrame, text_column: str = "text", budget: float = 0.8, power: float = 0.8, given: dict[str, dict] | None = None, topics: int = 16, local_cells: int = LOCAL_CELLS, tries: int = 12, rounds: int = ROUNDS) -> Mixture:
    """The raked mixture of docs (source, lang, text); see mix_sources()."""
    spark, given = docs.sparkSession, {m: _wanted(g) for m, g in (given or {}).items()}
    rows = docs.select(_named("source").alias("source"), _named("lang").alias("lang"), F.col(text_column).alias("text"))
    counted = stash(rows.mapInArrow(_counted(rows.columns, 2), "source string, lang string, n_tokens bigint, counts binary"))
    model = fit_topics(counted, topics)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(model.of(_matrix(b.column(3))))], ["source", "lang", "n_tokens", "topic"])

    told = counted.mapInArrow(assign, "source string, lang string, n_tokens bigint, topic int")
    cells = stash(told.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens")))
    discard(counted)
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    if not total:  # nothing to weigh: everything stays
        flat = cells.withColumn("probability", F.lit(1.0))
        none = spark.createDataFrame([], "margin string, category string, present double, target double, expected double")
        return Mixture(flat, none, 1.0, 0.0, model)
    local = cells.count() <= local_cells
    most = (1 + budget) / 2  # part of itself that a category gives by default: below one, so that its cells can still differ
    aim = spark.createDataFrame([(0, budget * total)], "all int, goal double")
    # each margin is flattened by itself to a power of its categories' sizes; the cells start as they are and are raked to that
    if local:
        got = cells.toPandas().sort_values(list(MARGINS), ignore_index=True)
        tokens, names, codes = got["tokens"].to_numpy(float), [], []
        for m in MARGINS:
            name, code = np.unique(got[m].to_numpy(), return_inverse=True)
            names.append(name)
            codes.append(code)
        held = [np.bincount(c, tokens, len(n)) for n, c in zip(names, codes, strict=True)]
        flat = [rake([np.zeros(len(t), np.int64)], t * most, np.minimum((t / total) ** power * (total * 1e-12), t * most), [np.array([budget * total])], rounds)[0] for t in held]
        tables = [pd.DataFrame({m: n, "tokens": t, "flat": f}) for m, n, t, f in zip(MARGINS, names, held, flat, strict=True)]
        sums = {m: spark.createDataFrame(t, f"{m} {'int' if m == 'topic' else 'string'}, tokens double, flat double") for m, t in zip(MARGINS, tables, strict=True)}
    else:
        sums = {}
        for m in MARGINS:
            whole = cells.groupBy(m).agg(F.sum("tokens").alias("tokens")).withColumn("tokens", F.col("tokens") * most)
            started = whole.withColumns({"x": F.least(F.pow(F.col("tokens") / (total * most), F.lit(power)) * F.lit(total * 1e-12), "tokens"), "all": F.lit(0)})
            sums[m] = rake_joined(started, {"all": aim}, rounds)[0].select(m, (F.col("tokens") / most).alias("tokens"), F.col("x").alias("flat"))
    targets, part = {}, budget
    for m in MARGINS:
        value = F.col("flat")
        if m in given:
            key = F.col(m).cast("string") if m != "topic" else F.concat(F.lit("="), F.col(m).cast("string"))
            value = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in given[m].items() for v in kv]), key), F.lit(0.0))
        value = F.when(F.col("tokens") > 0, value).otherwise(0.0)
        weighed = sums[m].withColumn("v", value)
        whole = weighed.agg(F.sum("v")).first()[0] or 0.0
        targets[m] = weighed.select(m, "tokens", (F.col("v") / (whole or 1.0)).alias("target"))
        least = targets[m].where("target > 0").agg(F.min(F.col("tokens") / F.col("target"))).first()[0]
        part = min(part, (least or 0.0) / total)  # a category cannot give more than it holds
    first = None
    if local:
        shares = []
        for m, name in zip(MARGINS, names, strict=True):
            want = {r[m]: r["target"] for r in targets[m].collect()}
            shares.append(np.array([want[n] for n in name.tolist()]))
    for k in range(tries):
        # given targets stay and the budget goes down; default ones move towards the shares that are there, which can always be met
        now, pull = (part * 0.9**k, 1.0) if given else (part, 0.9**k)
        if local:
            x, gap = rake(codes, tokens, tokens * now, [now * (total * pull * t + (1 - pull) * h) for t, h in zip(shares, held, strict=True)], rounds)
        else:
            x, gap = rake_joined(cells.withColumn("x", F.col("tokens") * now), {m: targets[m].select(m, ((F.col("target") * total * pull + F.col("tokens") * (1 - pull)) * now).alias("goal")) for m in MARGINS}, rounds)
        first = first or (x, gap, now, pull)
        if gap < CLOSE:
            break
    else:
        x, gap, now, pull = first
    targets = {m: t.withColumn("target", F.col("target") * pull + F.col("tokens") / total * (1 - pull)) for m, t in targets.items()}
    if local:
        got["x"] = x
        x = spark.createDataFrame(got[[*MARGINS, "tokens", "x"]], "source string, lang string, topic int, tokens double, x double")
    out = x.select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("x") / F.col("tokens")).otherwise(1.0).alias("probability"))
    taken = out.withColumn("x", F.col("tokens") * F.col("probability"))
    parts = [taken.groupBy(m).agg(F.sum("x").alias("x")).join(targets[m], m).select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("category"), (F.col("tokens") / total).alias("present"), "target", (F.col("x") / (now * total)).alias("expected")) for m in MARGINS]
    return Mixture(out, parts[0].union(parts[1]).union(parts[2]), now, gap, model)


def mix_sources(docs: DataFrame, key: str = "doc_id", text_column: str = "text", seed: int = 17, mixture: Mixture | None = None, local_cells: int = LOCAL_CELLS, **options) -> DataFrame:
    """docs with topic, n_tokens, weight, probability and kept.

    budget: the part of all tokens that the sample holds in expectation. given: target shares by margin and category
    (None: null). Margins that it leaves out take the shares of their categories flattened to `power` of their size, up to
    half of what the budget leaves of a category; cells start as they are, and raking alone brings them there. Where
    given targets need more than a category holds, the budget is lowered until they can be met; where default ones
    cannot be met together, they move by tenths towards the shares that are there. Targets that contradict each other are
    met as nearly as raking gets, and plan_mixture() reports every target and expected share, and the largest gap.

    weight is the probability over the budget. A null source or language is a category of its own. Texts without words
    weigh nothing: topic -1, and their cell's probability. Without any word in the table everything stays. Rows with
    the same key (null too) are kept or left together as far as they share a cell. Columns of these five names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("topic", "n_tokens", "weight", "probability", "kept")]
    docs = docs.select(*keep)
    mixture = mixture or plan_mixture(docs, text_column, local_cells=local_cells, **options)
    rows = with_topics(docs, mixture.topics, text_column).withColumns({"_s": _named("source"), "_l": _named("lang")})
    small = mixture.cells.selectExpr("source _s", "lang _l", "topic", "probability")
    if mixture.cells.count() <= local_cells:
        small = F.broadcast(small)  # at most local_cells rows
    out = rows.join(small, ["_s", "_l", "topic"], "left")
    chance = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) / float(1 << 53)
    return out.withColumns({"kept": chance < F.col("probability"), "weight": F.col("probability") / F.lit(mixture.budget)}).select(*keep, "topic", "n_tokens", "weight", "probability", "kept")


def mix_of_all(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept for every document."""
    return mix_sources(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")
