"""Secret scans with multipart credential linking, in DataFrame functions only.

Parts of credentials are found by patterns: access identifiers, secrets and endpoints. Strong parts are always reported:
assigned secrets, access identifiers of a known form, long hexadecimal strings. Weak candidates (account names, opaque strings,
endpoints) are everywhere, and are reported only where the complementary parts stand near them in the same scope, a
passage without a blank line: an account beside a secret, an opaque string beside an identifier, an endpoint beside both.
Nearness is an interval join: a part shows itself to every stretch of REACH code points that it touches, an identifier
also to those within REACH of it, and parts meet by equality of (document, scope, stretch). A stretch holds a bounded number
of parts, since parts of a kind do not overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key

REACH = 200


def _either(words: str) -> str:
    """A pattern for ASCII words in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
# name, class, pattern; in the order in which kinds are listed
KINDS = [
    ("assign", "secret", "(" + _either("password|passwd|secret|token|api_?key") + ")" + _SET + "([A-Za-z0-9+/_.=-]+)"),
    ("access", "id", "AKIA[A-Z0-9]+"),
    ("hex", "secret", "[0-9a-f]{32,}"),  # runs are maximal, so shorter ones take nothing away
    ("account", "id", "(" + _either("user_?name|user|login|account|client_?id|access_?key_?id") + ")" + _SET + "([A-Za-z0-9._@-]{3,})"),
    ("opaque", "secret", "[A-Za-z0-9+/_=-]{20,}"),
    ("endpoint", "endpoint", r"(https?|ftp|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(:[0-9]+)?"),
    ("break", "break", r"\n[ \t\r]*\n"),
]
STRONG = 3
_NAMES = [k for k, _, _ in KINDS]
_FASTER = {"opaque": "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"}  # the same maximal runs, tried at their starts only


def _good(kind: str, match: Column) -> Column:
    """Whether a match counts; those that do not still take their place."""
    if kind == "assign":
        return F.char_length(F.regexp_extract(match, dict((k, p) for k, _, p in KINDS)[kind], 2)) >= 8
    if kind == "access":
        return F.char_length(match) >= 16
    if kind == "opaque":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def _matches(text: Column, number: int) -> Column:
    """The matches of a kind in order: the code points between the one before and this one, its own, and whether it counts."""
    name, _, pattern = KINDS[number]
    pattern = _FASTER.get(name, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern), F.lit(1), F.size(found)).alias("gap"), found.alias("match"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("size"), _good(name, x["match"]).alias("good")))
    return F.when(text.rlike(pattern), rows)


def parts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, kind, start, stop, scope, covered) of every part in every whole text, strong or weak: places in code points, stop exclusive.

    covered: a strong part overlaps it. Null texts have none. Rows that share id and text give one set of parts.
    """
    text = F.col("text")
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_key(F.col(text_column)).alias("key"), F.col(text_column).alias("text"))
    several = [F.coalesce(_matches(text, i), F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,good:boolean>>")) for i in range(len(KINDS))]
    any_part = reduce(Column.__or__, [text.rlike(_FASTER.get(k, p)) for k, c, p in KINDS if c != "break"])
    rows = base.where(any_part).select("doc_id", "key", F.explode(F.concat(*several)).alias("m")).select("doc_id", "key", "m.*").dropDuplicates(["doc_id", "key", "kind", "at"])
    so_far = Window.partitionBy("doc_id", "key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = rows.withColumn("stop", stop).where("good").select("doc_id", "key", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")
    text_order = Window.partitionBy("doc_id", "key").orderBy("start", "kind")
    before, after = text_order.rowsBetween(Window.unboundedPreceding, 0), text_order.rowsBetween(0, Window.unboundedFollowing)
    strong = F.col("kind") < STRONG
    marked = placed.withColumns({
        "scope": F.count(F.when(F.col("kind") == _NAMES.index("break"), 1)).over(before),
        "covered": F.coalesce(F.max(F.when(strong, F.col("stop"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(strong, F.col("start"))).over(after) < F.col("stop"), F.lit(False)),
    })
    return marked.where(F.col("kind") != _NAMES.index("break"))


def _stretches(part: DataFrame, prefix: str, reach: int) -> DataFrame:
    """A row for each stretch of REACH code points within `reach` of a part; columns other than the keys take the prefix."""
    low, high = F.floor((F.col("start") - reach) / REACH), F.floor((F.col("stop") - 1 + reach) / REACH)
    shown = part.select("doc_id", "key", "scope", F.col("kind").alias(f"{prefix}_kind"), F.col("start").alias(f"{prefix}_start"), F.col("stop").alias(f"{prefix}_stop"), low.alias(f"{prefix}_low"), F.explode(F.sequence(low, high)).alias("stretch"))
    return shown.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))


def _near(a: str, b: str) -> Column:
    """The parts do not overlap, at most REACH code points lie between them, and this is the first stretch that shows both."""
    gap = F.greatest(F.col(f"{a}_start") - F.col(f"{b}_stop"), F.col(f"{b}_start") - F.col(f"{a}_stop"))
    return gap.between(0, REACH) & (F.col("stretch") == F.greatest(F.col(f"{a}_low"), F.col(f"{b}_low")))


def link_parts(found: DataFrame) -> DataFrame:
    """Identifiers beside secrets: doc_id, key, scope, kind, start and stop of both, and each endpoint (or null) that is near both of them."""
    number = {c: [i for i, (_, of, _) in enumerate(KINDS) if of == c] for c in ("id", "secret", "endpoint")}
    usable = found.where((F.col("kind") < STRONG) | ~F.col("covered") | (F.col("kind") == _NAMES.index("endpoint")))
    side = {c: usable.where(F.col("kind").isin(n)) for c, n in number.items()}
    keys = ["doc_id", "key", "scope", "stretch"]
    ids = _stretches(side["id"], "id", REACH)
    pairs = ids.join(_stretches(side["secret"], "secret", 0), keys).where(_near("id", "secret")).drop("secret_low")
    ends = ids.join(_stretches(side["endpoint"], "endpoint", 0), keys).where(_near("id", "endpoint")).select("doc_id", "key", "scope", "id_kind", "id_start", "endpoint_start", "endpoint_stop")
    linked = pairs.drop("stretch", "id_low").join(ends, ["doc_id", "key", "scope", "id_kind", "id_start"], "left")
    far = F.greatest(F.col("endpoint_start") - F.col("secret_stop"), F.col("secret_start") - F.col("endpoint_stop"))
    linked = linked.withColumns({c: F.when(far.between(0, REACH), F.col(c)) for c in ("endpoint_start", "endpoint_stop")})
    return linked.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63)))).distinct()


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, kind, start, stop) of all reported parts: strong ones, and the weak ones of links."""
    found = parts(docs, id_column, text_column)
    links = link_parts(found)
    named = [links.select("doc_id", "key", F.col(f"{s}_kind").alias("kind"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_stop").alias("stop")) for s in ("id", "secret")]
    named.append(links.where("endpoint_start IS NOT NULL").select("doc_id", "key", F.lit(_NAMES.index("endpoint")).alias("kind"), F.col("endpoint_start").alias("start"), F.col("endpoint_stop").alias("stop")))
    weak = reduce(DataFrame.unionByName, named).where(F.col("kind") >= STRONG).distinct()
    return found.where(F.col("kind") < STRONG).select("doc_id", "key", "kind", "start", "stop").unionByName(weak)


def secrets_of_all(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, a row for each row of docs.

    Null and empty texts have no spans (zeros, the hash of the empty string, an empty string). Null ids and repeated rows
    keep a row each; other columns are ignored, whatever their names. Texts are searched whole.
    """

    def said(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    spans = secret_spans(docs, id_column, text_column).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("s"))
    count = lambda i: F.size(F.filter("s", lambda x: x["kind"] == i)).cast("bigint")
    told = spans.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), *[count(i).alias(f"n_{_NAMES[i]}") for i in range(STRONG)], F.sha2(said(F.filter("s", lambda x: x["kind"] < STRONG)), 256).alias("base_sha256"), said(F.col("s")).alias("spans"))
    keyed = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_key(F.col(text_column)).alias("key"))
    both = keyed.join(told, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    return both.select("doc_id", *[F.coalesce(f"n_{n}", F.lit(0).cast("bigint")).alias(f"n_{n}") for n in _NAMES[:STRONG]], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
