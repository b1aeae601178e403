"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import alignment_of_all
from .collocations import collocations
from .common import drop_shuffles, small_batches
from .credentials import KINDS, REACH, secrets_of_all
from .fingerprint import fingerprints
from .language import language_of_all
from .lm_scoring import lm_of_all
from .media import media_digest
from .mixing import mix_of_all
from .ngram_join import jaccard_classes
from .packing import pack
from .quality import quality_of_all
from .substring_dedup import substrings_of_all
from .token_files import token_digest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_attention_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_of_all(_documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_documents(spark, sf_dir))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings_of_all(_documents(spark, sf_dir))


def op4_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_documents(spark, sf_dir))


def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of_all(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_all(_documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_documents(spark, sf_dir))


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(_documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_of_all(_documents(spark, sf_dir))


def op11_text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_of_all(_documents(spark, sf_dir))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(drop_shuffles(spark), sf_dir))


def op13_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_of_all(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_attention_scoring, op2_token_files, op3_paragraph_dedup, op4_multiset_fingerprint, op5_byte_cnn_quality, op6_language_filters, op7_best_fit_packing, op8_ngram_join, op9_avi_media, op10_source_mixing, op11_text_alignment, op12_phrase_collocations, op13_credential_links)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# every pair of documents that shares a shingle, exact Jaccard, and all that links reach
OP8_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON r.doc_id = b.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""


# every occurrence of one to four words within a piece, the lowest cut of each candidate, and no candidate within a longer one
OP12_SQL = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS MATERIALIZED (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
q AS MATERIALIZED (SELECT * FROM f WHERE f >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM q WHERE k >= 2),
h AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM c, (SELECT unnest(range(1, 4)) AS cut) WHERE cut < k),
u AS MATERIALIZED (SELECT h.lang, h.phrase, a, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * a) // (x.f + y.f)::HUGEINT AS score FROM h JOIN q x ON x.lang = h.lang AND x.phrase = head JOIN q y ON y.lang = h.lang AND y.phrase = tail),
m AS MATERIALIZED (SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM u) WHERE place = 1),
i AS MATERIALIZED (SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS sub FROM c, (SELECT unnest(range(2, 4)) AS s) WHERE s < k) GROUP BY ALL),
g AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m LEFT JOIN i ON i.lang = m.lang AND i.sub = m.phrase WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * m.a)
SELECT g.lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM g JOIN n USING (lang) WHERE rank <= 2000"""


def _op13_sql() -> str:
    """Matches placed by the lengths before them, and weak parts that an identifier-secret pair within reach confirms."""
    quoted = {k: p.replace("'", "''") for k, _, p in KINDS}
    good = {"assign": f"length(regexp_extract(m, '{quoted['assign']}', 2)) >= 8", "access": "length(m) >= 16", "opaque": "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"}
    found = " UNION ALL ".join(f"SELECT rid, {i} AS kind, regexp_extract_all(text, '{quoted[k]}') AS f, string_split_regex(text, '{quoted[k]}') AS g FROM d" for i, (k, _, _) in enumerate(KINDS))
    counts = "CASE kind " + " ".join(f"WHEN {i} THEN {good[k]}" for i, (k, _, _) in enumerate(KINDS) if k in good) + " ELSE true END"
    of = {c: ", ".join(str(i) for i, (_, x, _) in enumerate(KINDS) if x == c) for c in ("id", "secret", "endpoint")}
    gap = lambda a, b: f"greatest({a}.start - {b}.stop, {b}.start - {a}.stop) BETWEEN 0 AND {REACH}"
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _, _) in enumerate(KINDS)) + " END"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT rid, kind, f, g, unnest(range(1, len(f) + 1)) AS i FROM ({found}) AS a WHERE len(f) > 0),
y AS (SELECT rid, kind, f[i] AS m, sum(length(g[i]) + length(f[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM x),
z AS MATERIALIZED (SELECT rid, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM y WHERE {counts}),
p AS MATERIALIZED (SELECT *, count(CASE WHEN kind = 6 THEN 1 END) OVER w AS scope,
  coalesce(max(CASE WHEN kind < 3 THEN stop END) OVER w > start, false) OR coalesce(min(CASE WHEN kind < 3 THEN start END) OVER v < stop, false) AS covered FROM z
  WINDOW w AS (PARTITION BY rid ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY rid ORDER BY start, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS MATERIALIZED (SELECT * FROM p WHERE kind < 3 OR kind = 5 OR (kind < 5 AND NOT covered)),
l AS MATERIALIZED (SELECT a.rid, a.scope, a.kind AS ak, a.start AS a1, a.stop AS a2, b.kind AS bk, b.start AS b1, b.stop AS b2 FROM u a JOIN u b ON a.rid = b.rid AND a.scope = b.scope
  WHERE a.kind IN ({of['id']}) AND b.kind IN ({of['secret']}) AND {gap('a', 'b')}),
e AS (SELECT DISTINCT c.rid, c.kind, c.start, c.stop FROM l JOIN u c ON c.rid = l.rid AND c.scope = l.scope WHERE c.kind IN ({of['endpoint']}) AND greatest(a1 - c.stop, c.start - a2) BETWEEN 0 AND {REACH} AND greatest(b1 - c.stop, c.start - b2) BETWEEN 0 AND {REACH}),
r AS (SELECT rid, kind, start, stop FROM p WHERE kind < 3 UNION SELECT rid, ak, a1, a2 FROM l WHERE ak >= 3 UNION SELECT rid, bk, b1, b2 FROM l WHERE bk >= 3 UNION SELECT * FROM e),
t AS (SELECT rid, count(CASE WHEN kind = 0 THEN 1 END) AS n_assign, count(CASE WHEN kind = 1 THEN 1 END) AS n_access, count(CASE WHEN kind = 2 THEN 1 END) AS n_hex,
  string_agg(CASE WHEN kind < 3 THEN {name} || ':' || start || ':' || stop END, ',' ORDER BY start, kind) AS base, string_agg({name} || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op8_ngram_join": OP8_SQL, "op12_phrase_collocations": OP12_SQL, "op13_credential_links": _op13_sql()}
