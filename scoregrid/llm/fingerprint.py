"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (here: the sentences of its lines). Each is hashed to a wide vector, and the
vectors are summed, so the order does not matter and a paragraph is inserted or deleted by adding or subtracting.
Four coordinates are uniform modulo 2^61 and decide equality. 120 more are one hash bit each, summed three to a long
(20 bits apart, modulo 2^62); twice such a sum less the number of paragraphs is a sum of random signs, whose products
estimate the inner products of multisets and from them the likeness |A n B| / |A u B|.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_bounds, id_range, parts_for

PARAGRAPH = r"\n+|(?<=[.!?]) +"
FIELD = 20
BITS = 1 | 1 << FIELD | 1 << 2 * FIELD
M61, M62 = (1 << 61) - 1, (1 << 62) - 1


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: p != "")


def _once(value: Column, use) -> Column:
    """use(value), with the value evaluated a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vector(text: Column) -> Column:
    """array<bigint>: the number of paragraphs, 4 coordinates for equality, 40 packed ones for likeness."""

    def total(parts: Column, seed: int) -> Column:
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: (a + F.xxhash64(p, F.lit(seed)).bitwiseAND(F.lit(M61))).bitwiseAND(F.lit(M61)))

    def packed(parts: Column, seed: int) -> Column:
        def lanes(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(FIELD - 1)), lambda j: F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: (a + F.call_function("shiftrightunsigned", x, j).bitwiseAND(F.lit(BITS))).bitwiseAND(F.lit(M62))))

        return _once(F.transform(parts, lambda p: F.xxhash64(p, F.lit(seed))), lanes)

    return _once(paragraphs(text), lambda parts: F.concat(F.array(F.size(parts).cast("bigint"), *[total(parts, s) for s in (1, 2, 3, 4)]), packed(parts, 5), packed(parts, 6)))


def add(a: Column, b: Column) -> Column:
    """The vector of both multisets together."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), F.sequence(F.lit(0), F.lit(44)), lambda v, i: v.bitwiseAND(F.when(i < 5, F.lit(M61)).otherwise(F.lit(M62))))


def remove(a: Column, b: Column) -> Column:
    """The vector of a without the paragraphs of b, which a must hold."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x - y), F.sequence(F.lit(0), F.lit(44)), lambda v, i: v.bitwiseAND(F.when(i < 5, F.lit(M61)).otherwise(F.lit(M62))))


def as_text(v: Column) -> Column:
    """A fingerprint as hexadecimal digits, 16 for each coordinate."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated |A n B| / |A u B| of two vectors, 0 to 1; 1 for equal ones, 0 if only one is empty."""
    low = (1 << FIELD) - 1

    def product(u: Column, v: Column) -> Column:
        def field(x: Column, n: Column, k: int) -> Column:
            return (2 * F.shiftrightunsigned(x, k * FIELD).bitwiseAND(F.lit(low)) - n).cast("double")

        n, m = F.get(u, F.lit(0)), F.get(v, F.lit(0))
        pairs = F.zip_with(F.slice(u, 6, 40), F.slice(v, 6, 40), lambda x, y: field(x, n, 0) * field(y, m, 0) + field(x, n, 1) * field(y, m, 1) + field(x, n, 2) * field(y, m, 2))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 120

    both = product(a, b)
    part = both / F.greatest(product(a, a) + product(b, b) - both, F.lit(1e-9))
    return F.when(a == b, 1.0).when((F.get(a, F.lit(0)) == 0) | (F.get(b, F.lit(0)) == 0), 0.0).otherwise(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))


def with_next(docs: DataFrame, key: str, columns: list[str], per_part: int = 2000) -> DataFrame:
    """Each row with the next row's columns as next_<name>, ascending by key (null first), the last row's next being the first.

    Rows are dealt into ranges of the key; the first row of each range is also shown to the range before it.
    Equal keys are ordered by the hash of the columns.
    """
    bounds = id_bounds(docs, key, min(16384, parts_for(docs, key, per_part)))
    tie = F.xxhash64(*columns)
    ranged = docs.withColumns({"_part": id_range(F.col(key), bounds), "_tie": tie})
    first = ranged.groupBy("_part").agg(F.min(F.struct(F.coalesce(F.col(key), F.lit(-(1 << 63))).alias("k"), F.col("_tie").alias("t"))).alias("f"))
    order = Window.orderBy("_part")  # at most 16,384 rows
    back = first.select("_part", "f", F.coalesce(F.lag("_part").over(order), F.max("_part").over(Window.partitionBy())).alias("_before"), F.lag("_part").over(order).isNull().alias("_wrap"))
    shown = ranged.join(F.broadcast(back), "_part", "left").withColumn("_is_first", F.coalesce((F.coalesce(F.col(key), F.lit(-(1 << 63))) == F.col("f.k")) & (F.col("_tie") == F.col("f.t")), F.lit(False)))
    copies = F.when(F.col("_is_first"), F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("g"), F.lit(False).alias("w")), F.struct(F.col("_before").alias("p"), F.lit(True).alias("g"), F.col("_wrap").alias("w")))).otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("g"), F.lit(False).alias("w"))))
    dealt = shown.withColumn("_c", F.explode(copies)).select(key, *columns, "_tie", "_c.p", "_c.g", "_c.w")
    within = Window.partitionBy("p").orderBy("w", key, "_tie", "g")
    return dealt.select(key, *columns, "g", *[F.lead(c).over(within).alias(f"next_{c}") for c in columns]).where(~F.col("g")).drop("g")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, a row for each row.

    Null texts count as empty; an empty text has the fingerprint of no paragraphs. A table of one row is its own next.
    Null ids come first, equal ids are ordered by their texts' hashes. Other columns are ignored.
    """
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    two = with_next(base.withColumn("v", vector(F.col("text"))), "doc_id", ["text", "v"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = two.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "v", "next_v")
    out = out.withColumn("e", vector(F.col("edited")))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("v")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"))
