"""Each operator against brute force, exact round trips or held-out accuracy, on small tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoregrid.llm import fingerprint, graph, language, lm_scoring, media, mixing, ngram_join, packing, quality, substring_dedup, token_files, tokens

SMALL = "/root/testdata/sf0.001"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def split(x):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(x)) if w]


def encoded(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path(name))
    t.encode_special_tokens = True
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_components_of_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(i, i + 1) for i in range(500, 560)]
    root = graph.union_find(np.array([a for a, _ in links]), np.array([b for _, b in links]), 600)
    want = {x: int(root[x]) for p in links for x in p if p[0] != p[1]}
    for batch in (500_000, 30):
        monkeypatch.setattr(graph, "BATCH", batch)
        got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == want


def test_ngram_classes(docs, none):
    rows = docs.collect()

    def grams(x):
        w = split(x)
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
    root = {i: i for i in ids}
    named = [(r["doc_id"], grams(r["text"])) for r in rows if r["doc_id"] is not None]
    for _ in range(3):
        for i, a in named:
            for j, b in named:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = ngram_join.jaccard_classes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else root[r["doc_id"]] if r["n_shingles"] else r["doc_id"])
    assert sorted((r["n_shingles"]) for r in got) == sorted(len(grams(r["text"])) for r in rows)
    assert ngram_join.jaccard_classes(none).count() == 0


def test_ngram_join_against_its_sql(spark):
    import duckdb

    from scoregrid.llm import queries

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = c.sql(queries.oracle_sql()["op8_ngram_join"])
    got = queries.op8_ngram_join(spark, SMALL)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


def test_rows_that_share_an_id_are_one_node(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "XYZ"}
    table = spark.createDataFrame([(5, text["X"]), (3, text["X"]), (5, text["Y"]), (9, text["Y"]), (7, text["Z"]), (5, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.jaccard_classes(table).collect()}
    assert got == {(5, 26): 3, (3, 26): 3, (9, 26): 3, (7, 26): 7, (5, 0): 5}


def test_rtree_bound_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 200 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in rng.integers(0, 60, 90)]
    n, vec = np.array([len(s) for s in sets]), np.stack([ngram_join._vector(s) for s in sets])
    i, j = ngram_join.rtree_pairs(n, vec, np.arange(len(sets)), 75)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (n[a] + n[b] - both):
                assert (b, a) in found
    assert len(found) < len(sets) * (len(sets) - 1) / 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_encode_like_whole_texts(spark, docs, name):
    texts = [r["text"] for r in docs.collect()] + ["   lead", "trail   ", "a  b   c", "x\n y", "x \ny", "I'll we've 'S can't.don't", " nbsp x", "a,b.c!d", "ǅ ΣΑΣ. İi", "tab\tx\r\n\r\ny", "été,fini.", "́combining ́x"]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want, got = encoded(texts, name, 0), [None] * len(texts)
    for row, ids, at in tokens.SegmentEncoder(tokens.vocabulary_path(name))(pa.array(texts, pa.string())):
        for k in range(len(at) - 1):
            got[row + k] = ids[at[k] : at[k + 1]].tolist()
    assert got == [w[:-1].tolist() for w in want]


def test_words_with_a_prefix_leave_bare_words_alone(spark):
    """LM scoring asks the worker's encoder for " word"; token files must then still find the ids of "word"."""
    name = tokens.vocabulary_path("byte_bpe_50k.json")
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    encode = tokens.SegmentEncoder(name)
    column = pa.array(texts, pa.string())
    for _, buf, offs in tokens.text_chunks(column):
        low = lm_scoring.LOWER[buf]
        s, e, _ = lm_scoring.word_spans(low, offs)
        h = lm_scoring.span_hashes(low, s, e)
        keys, code = np.unique(h, return_inverse=True)
        encode.entries(keys, code, low, s, e, " ")
    got = [None] * len(texts)
    for row, ids, at in encode(column):
        for k in range(len(at) - 1):
            got[row + k] = ids[at[k] : at[k + 1]].tolist()
    assert got == [w[:-1].tolist() for w in encoded(texts, name, 0)]


def test_runs_of_latin_letters_and_marks_need_the_model_alone():
    """Words of LM scoring: a run of Latin letters, with or without marks behind it, has the library's ids without its slower whole encoding."""
    encode = tokens.SegmentEncoder(tokens.vocabulary_path("byte_bpe_50k.json"))
    library = encode.tokenizer

    class ModelOnly:
        model = library.model

    encode.tokenizer = ModelOnly()
    words = ["zebra", "zebra,", "zebra...", "the?!", "éoiouauxaian", "einungää.", "ereinstß;;", "a", "ü", "\u01c5x#"]
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = lm_scoring.word_spans(buf, np.array([0, len(buf)]))
    ids, at = lm_scoring.word_ids(encode, lm_scoring.span_hashes(buf, s, e), np.arange(len(s)), buf, s, e)
    want = [library.encode(" " + w, add_special_tokens=False).ids for w in words]
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == want


def test_token_queries_in_one_session(spark):
    """Token files before and after LM scoring, in the same workers, against the tokenizers library."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    ids = encoded([r["text"] for r in rows], "byte_bpe_50k.json", 2)
    want = {r["doc_id"]: (len(w), zlib.crc32(w.tobytes())) for r, w in zip(rows, ids, strict=True)}
    for _ in range(2):
        assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digest(docs).collect()} == want
        lm_scoring.lm_of_all(docs).count()


def test_single_tokens_of_a_written_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, per_part=30)
    ids = {r["doc_id"]: w for r, w in zip(rows, encoded([r["text"] for r in rows], "byte_bpe_50k.json", 2), strict=True)}
    asked = [(d, p) for d, w in ids.items() for p in (0, len(w) // 2, len(w) - 1, len(w), -1)] + [(10**9, 0), (None, 0)]
    got = token_files.read_tokens(spark, path, spark.createDataFrame(asked, "doc_id long, position long")).collect()
    assert {(r["doc_id"], r["position"], r["token"]) for r in got} == {(d, p, int(ids[d][p])) for d, p in asked if d in ids and 0 <= p < len(ids[d])}
    assert len(got) == len({(r["doc_id"], r["position"]) for r in got})


def test_token_files(spark, docs, none, tmp_path):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, per_part=4)
    got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    want = {(r["doc_id"], w.tobytes()) for r, w in zip(rows, encoded([r["text"] for r in rows], "byte_bpe_50k.json", 2), strict=True)}
    assert {(r["doc_id"], bytes(r["ids"])) for r in got} == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert token_files.token_digest(none).count() == 0


def test_direct_access():
    ids = np.random.default_rng(3).choice([5, 255, 256, 70_000, 1 << 24, 50256], 3000)
    codes = token_files.DirectCodes.from_bytes(token_files.DirectCodes.of(ids).to_bytes())
    assert codes.all().tolist() == ids.tolist()
    assert [codes[i] for i in range(0, 3000, 37)] == ids[::37].tolist()


def test_packing(docs, none):
    rows = docs.collect()
    want = Counter()
    for r, ids in zip(rows, encoded([r["text"] for r in rows], "word_bpe_49k.json", 1), strict=True):
        for k in range(0, len(ids), 4096):
            want[(r["doc_id"], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))] += 1
    got = packing.pack(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack(none).count() == 0


def fewest_bins(items, size):
    """All ways to put descending items into bins, without repeats of equal bins."""
    low = len(items)

    def go(k, bins):
        nonlocal low
        if len(bins) >= low:
            return
        if k == len(items):
            low = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[k] <= size:
                go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return low


def histogram(items, size):
    counts = [0] * (size + 1)
    for x in items:
        counts[x] += 1
    return counts


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(4)
    for case in range(200):
        size = int(rng.integers(8, 60))
        low = 1 if case % 2 else max(1, size // 5)
        items = sorted((int(x) for x in rng.integers(low, size + 1 if case % 3 else size * 2 // 3 + 1, int(rng.integers(1, 11)))), reverse=True)
        got = packing.solve(histogram(items, size), size)
        assert Counter(x for p, t in got.patterns for x in p * t) == Counter(items)
        assert all(sum(p) <= size for p, _ in got.patterns)
        assert got.proved and got.sequences == got.lower == fewest_bins(items, size)


def test_fillings_are_the_undominated_ones():
    """Against every subset: a filling is dominated if another holds its items in place of larger ones."""
    from itertools import combinations

    rng = np.random.default_rng(11)
    for _ in range(60):
        room = int(rng.integers(6, 25))
        items = sorted((int(x) for x in rng.integers(1, room + 1, int(rng.integers(1, 8)))), reverse=True)
        subsets = {tuple(items[i] for i in c) for k in range(len(items) + 1) for c in combinations(range(len(items)), k) if sum(items[i] for i in c) <= room}

        def fits(small, into):  # the items of `small` packed into bins of the sizes `into`
            if not small:
                return True
            return any(small[0] <= b and fits(small[1:], (*into[:i], b - small[0], *into[i + 1 :])) for i, b in enumerate(into))

        best = {f for f in subsets if not any(g != f and fits(f, g) for g in subsets)}
        got = [tuple(f) for f in packing.fillings(histogram(items, room), room, room)]
        assert len(got) == len(set(got)) and set(got) >= best
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
        assert set(got) == best


def test_packing_tells_its_gap():
    """An unfinished search still packs everything and says what is not proved; a hot length over half is proved by the bound."""
    rng = np.random.default_rng(12)
    counts = histogram([int(x) for x in rng.integers(200, 2000, 900)], 4096)
    got = packing.solve(counts, 4096, nodes=5)
    assert Counter(x for p, t in got.patterns for x in p * t) == Counter({s: c for s, c in enumerate(counts) if c})
    assert got.lower <= got.sequences <= got.lower + 2
    hot = histogram([2049] * 5000 + [1500] * 100, 4096)
    got = packing.solve(hot, 4096)
    assert got.proved and got.sequences == 5000


def test_fingerprints(spark, docs, none):
    rows = docs.where("doc_id is not null and doc_id <> 13").select("doc_id", "text")
    plain = sorted(rows.collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(rows).collect()}
    for i, r in enumerate(plain):
        x, y = r["text"] or "", plain[(i + 1) % len(plain)]["text"] or ""
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"]
    assert got[0]["near_next"] == 1.0
    assert fingerprint.fingerprints(docs).count() == docs.count()
    assert fingerprint.fingerprints(none).count() == 0
    v = fingerprint.vector
    t = spark.createDataFrame([("A b. C d.\nE f!", "E f!\nC d. A b.", "A b.\nC d.", "E f!")], "a string, b string, c string, d string")
    whole, turned, part, rest = (v(F.col(c)) for c in "abcd")
    r = t.select(whole == turned, fingerprint.add(part, rest) == whole, fingerprint.remove(whole, rest) == part, fingerprint.likeness(whole, part)).first()
    assert tuple(r)[:3] == (True, True, True) and 0.3 < r[3] <= 1


def test_fingerprints_against_a_plain_version(docs):
    """Every coordinate by its definition, and likeness from sums of random signs."""
    import struct

    import xxhash

    def one_hash(text, seed):
        return xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(text.encode(), seed=42).intdigest()).intdigest()

    def vector(text):
        parts = [p for p in re.split(r"\n+|(?<=[.!?]) +", text) if p]
        whole = [len(parts)] + [sum(one_hash(p, s) & fingerprint.M61 for p in parts) & fingerprint.M61 for s in (1, 2, 3, 4)]
        signs = []
        for s in (5, 6):
            hashes = [one_hash(p, s) for p in parts]
            whole += [sum((h >> j) & fingerprint.BITS for h in hashes) & fingerprint.M62 for j in range(fingerprint.FIELD)]
            signs += [2 * sum(h >> (j + fingerprint.FIELD * k) & 1 for h in hashes) - len(parts) for j in range(fingerprint.FIELD) for k in range(3)]
        return whole, np.array(signs, float)

    rows = docs.where("doc_id is not null and doc_id <> 13").select("doc_id", "text")
    plain = sorted(rows.collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(rows).collect()}
    for i, r in enumerate(plain):
        x, y = r["text"] or "", plain[(i + 1) % len(plain)]["text"] or ""
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        (v, a), (w, b), (e, c) = vector(x), vector(y), vector(edited)
        g = got[r["doc_id"]]
        assert g["fingerprint"] == "".join(f"{k:016X}" for k in v) and g["edited_fingerprint"] == "".join(f"{k:016X}" for k in e)
        for name, u, z, su, sz in (("near_next", v, w, a, b), ("near_edited", v, e, a, c)):
            want = 1.0 if u == z else 0.0 if 0 in (u[0], z[0]) else min(1.0, max(0.0, float(su @ sz / max(1e-9 * 120, su @ su + sz @ sz - su @ sz))))
            assert g[name] == pytest.approx(want, abs=1e-9)


def test_fingerprint_plan_is_native(docs):
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_languages(spark, docs, none):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = table.select("doc_id", "lang").join(language.language_of_all(table), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0
    model = language.fit(table)
    out = {(r["doc_id"], r["text"]): r for r in language.predict(docs, model).collect()}
    assert len(out) == docs.select("doc_id", "text").distinct().count()
    for (_, text), r in out.items():
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
        assert 0 <= r["score"] <= 1 and r["start"] == 7
    assert language.predict(none, language.fit(none)).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(none)).collect()} == {"und"}


def test_language_filters_hold_every_gram(spark):
    """Seventy languages, two words of masks: every gram of a labelled text has its language's bit, against plain sets."""
    rng = np.random.default_rng(14)
    letters = np.array(list("abcdefghijklmnop"))
    rows = [(i, "".join(rng.choice(letters, 60)), f"l{i % 70:03d}") for i in range(210)]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == sorted({r[2] for r in rows})
    has = {name: set() for name in m.languages}
    for _, text, lang in rows:
        padded = f" {text} ".encode()
        has[lang] |= {padded[k : k + 5] for k in range(len(padded) - 4)}
    for i, name in enumerate(m.languages):
        code = np.array([int.from_bytes(g, "little") for g in has[name]], np.uint64)
        a, b = m.slots(code, m.bits)
        assert (((m.table[i // 64][a] & m.table[i // 64][b]) >> np.uint64(i % 64)) & np.uint64(1)).all(), name
    out = {r["doc_id"]: r for r in language.predict(spark.createDataFrame([*rows, (999, "!", None), (998, "zzzzzz", None)], "doc_id long, text string, lang string"), m).collect()}
    for i, text, lang in rows:
        padded = f" {text} ".encode()
        share = {name: np.mean([padded[k : k + 5] in g for k in range(len(padded) - 4)]) for name, g in has.items()}
        assert out[i]["lang_pred"] == lang == max(share, key=share.get) and out[i]["known"] == pytest.approx(1)
    assert out[999]["lang_pred"] == "und" and (out[998]["lang_pred"], out[998]["score"]) == ("l000", 0)


def test_quality(spark, docs, none):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_of_all(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    good, bad = (got[got["quality"] == k]["score"].to_numpy() for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.9
    model = quality.fit(docs.drop("score"), spark.createDataFrame([(0, 1), (8, 0), (9, None)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(none, quality.fit(none, lab.limit(0))).count() == 0


def test_network_against_a_plain_forward_pass():
    rng = np.random.default_rng(15)
    p = quality.train(rng.integers(0, 255, (6, quality.CHUNK), dtype=np.uint8), np.array([0, 0, 1, 2, 2, 2]), np.array([1, 0, 1]), epochs=1)
    x = rng.integers(0, 255, (3, quality.CHUNK), dtype=np.uint8)
    for got, chunk in zip(quality.logits(p, x), x, strict=True):
        best = np.full(quality.FILTERS, -np.inf)
        for k in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP):
            seen = np.concatenate([p["embed"][c] for c in chunk[k : k + quality.WIDTH]])
            best = np.maximum(best, seen @ p["filters"])
        hidden = np.tanh(np.maximum(best + p["shift"], 0) @ p["dense"] + p["dense_b"])
        assert got == pytest.approx(float((hidden @ p["out"] + p["out_b"])[0]), abs=1e-4)


def test_repeated_and_tied_labels(spark, docs):
    """Of several labels of an id the largest counts; equal texts get equal scores."""
    labels = spark.createDataFrame([(0, 0), (0, 1), (8, 0), (9, 0), (None, 1)], "doc_id long, quality int")
    plain = spark.createDataFrame([(0, 1), (8, 0), (9, 0)], "doc_id long, quality int")
    a, b = (quality.fit(docs, x) for x in (labels, plain))
    assert all(np.array_equal(a[k], b[k]) for k in a)
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(docs, a).collect()}
    assert got[0, docs.where("doc_id = 0").first()["text"]] == pytest.approx(got[1, docs.where("doc_id = 1").first()["text"]])


def test_memory_is_given_back_across_small_batches(monkeypatch):
    """Batches of a few megabytes, as the queries set them, are counted together."""
    from scoregrid.llm import common

    given, real = [], common.give_back
    monkeypatch.setattr(common, "give_back", lambda: (given.append(1), real()))
    batch = pa.array(["a" * 1000] * 2000)
    for _ in range(10):
        assert sum(len(buf) for _, buf, _ in common.text_chunks(batch)) == 2_000_000
    assert len(given) >= 3


def test_chunks_cover_every_byte():
    text = np.random.default_rng(5).integers(1, 255, 1000, dtype=np.uint8)
    for n in (0, 1, 127, 128, 129, 224, 225, 1000):
        x, at = quality.cut(text[:n], np.array([0, n]))
        seen = np.zeros(n, bool)
        for k in range(at[1]):
            piece = x[k][: max(0, min(quality.CHUNK, n - k * quality.SHIFT))]
            assert np.array_equal(piece, text[k * quality.SHIFT : k * quality.SHIFT + len(piece)])
            seen[k * quality.SHIFT : k * quality.SHIFT + len(piece)] = True
        assert seen.all()


def test_lm_scores(spark, docs, none):
    table = docs.select("doc_id", "text").union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    got = lm_scoring.lm_of_all(table).collect()
    rows = [(r["doc_id"], [*split(r["text"]), None]) for r in table.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows for w in t if not held(i))
    n, v = sum(c.values()), len(c)
    want = sorted(((str(i), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 3)) for i, t in rows), key=str)
    assert sorted(((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in got), key=str) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 and r["held_out"] == held(r["doc_id"]) for r in got)
    seen = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)
    assert lm_scoring.lm_of_all(none).count() == 0


VOCABULARY = "byte_bpe_50k.json"


def small_model(seed=6):
    """A model of the right shape with weights away from zero, and its id counts."""
    rng = np.random.default_rng(seed)
    tokenizer = tokens.SegmentEncoder(tokens.vocabulary_path(VOCABULARY)).tokenizer
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    begins = np.array([x.startswith("\u0120") for x in names])
    counts = np.append(rng.integers(0, 40, len(names)) * (rng.random(len(names)) < 0.1), 30)
    classes = lm_scoring.Classes.frequent(counts, begins, names)
    net = lm_scoring.Attention(classes, np.bincount(classes.of, counts, classes.count))
    net.p["rel"] = rng.standard_normal(lm_scoring.BACK).astype(np.float32)
    return lm_scoring.Model(classes, net, []), counts, begins


def contexts(row, text):
    """Items and mask of each target by the plain rule: the BACK items before it in its own text."""
    at = np.arange(len(row))
    back = at[:, None] - np.arange(lm_scoring.BACK)
    mask = (back >= 0) & (text[np.maximum(back, 0)] == text[:, None])
    return row[np.maximum(back, 0)], mask.astype(np.float32)


def test_windows_give_the_same_as_whole_contexts(monkeypatch):
    model, _, _ = small_model()
    rng = np.random.default_rng(7)
    row, y = (rng.integers(0, model.classes.count, 300) for _ in range(2))
    text = np.sort(rng.integers(0, 5, 300))
    want = model.net.log_probs(*contexts(row, text), y)
    for size in (64, 1 << 13):
        monkeypatch.setattr(lm_scoring, "SLICE", size)
        assert np.allclose(model.net.scores(row, text, y)[0], want, atol=2e-4)


def test_scores_by_ready_tables(monkeypatch):
    """Tables of what depends on items alone, made once, give the plain result where texts end at, before and after the borders of slices."""
    model, _, _ = small_model()
    rng = np.random.default_rng(17)
    row, y = (rng.integers(0, model.classes.count, 300) for _ in range(2))
    monkeypatch.setattr(lm_scoring, "SLICE", 64)
    tables = model.net.tables()
    for cuts in ([], [64, 128], [63, 65, 127], [1, 60, 61, 62, 63, 64, 65, 299]):
        text = np.searchsorted(cuts, np.arange(300), "right")
        got = model.net.scores(row, text, y, tables)
        assert np.allclose(got[0], model.net.log_probs(*contexts(row, text), y), atol=2e-4)


def test_gradients_are_those_of_the_loss():
    model, _, _ = small_model()
    rng = np.random.default_rng(8)
    net, n = model.net, 40
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    row, y = (rng.integers(0, model.classes.count, n) for _ in range(2))
    items, mask = contexts(row, np.sort(rng.integers(0, 4, n)))
    g = net.gradients(items, mask, y)
    for k, v in net.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, d)) for d in v.shape) if k != "e" else (int(items[3, 0]), int(rng.integers(0, lm_scoring.DIM)))
            old, two = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = old + step
                two.append(-net.log_probs(items, mask, y).mean())
            v[at] = old
            assert g[k][at] == pytest.approx((two[0] - two[1]) / 2e-5, abs=1e-6, rel=1e-3), k


def test_predictions_of_all_ids_sum_to_one():
    model, counts, begins = small_model()
    pairs = np.random.default_rng(9).integers(0, 3, (model.classes.count, model.classes.count)).astype(float)
    mixed = lm_scoring.Mixed(model, pairs, counts)
    for before in (model.end, 300, 40_000):
        logs, edge = mixed.logs(np.full(model.end + 1, before), np.arange(model.end + 1), np.arange(model.end + 1))
        p = np.exp(logs.astype(np.float64))
        assert p.sum() == pytest.approx(1, abs=1e-3) and p[np.append(begins, True)].sum() == pytest.approx(np.exp(float(edge[0])), abs=1e-3)
    assert np.allclose(lm_scoring.pair_shares(np.random.default_rng(1).integers(0, 3, (50, 50))).sum(1), 1)


def test_scores_against_a_plain_version():
    """Each word: its first id, then the counted or spelled rest, with contexts of whole texts."""
    model, counts, _ = small_model()
    pairs = np.random.default_rng(9).integers(0, 3, (model.classes.count, model.classes.count)).astype(float)
    mixed = lm_scoring.Mixed(model, pairs, counts)
    texts = ["The oninganea of the ertion was.", None, "", "Zebra zebra the", "the " * 60]
    known = {"the": 9, "was.": 2, "zebra": 1}
    first_n, first_v = np.zeros(model.end), np.zeros(model.end)
    name = tokens.vocabulary_path(VOCABULARY)
    tokenizer = tokens.SegmentEncoder(name).tokenizer
    of = lambda w: tokenizer.encode(" " + w, add_special_tokens=False).ids
    for w, c in known.items():
        first_n[of(w)[0]] += c
        first_v[of(w)[0]] += 1
    words = sorted({w for t in texts for w in split(t)})
    raw = [w.encode() for w in words]
    end = np.cumsum([len(x) for x in raw])
    h = lm_scoring.span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(x) for x in raw], end).view(np.int64)
    table = pa.table({"h": h, "c": [known.get(w, 0) for w in words]})
    got = lm_scoring._score(mixed, name, 4, first_n, first_v, 0.4)(pa.table({"id": pa.array([1, 2, 3, 4, None], pa.int64()), "held": [True, False, False, True, False], "text": pa.array(texts, pa.string())}), table)
    c = model.classes
    for row, t in zip(got.to_pylist(), texts, strict=True):
        ids = [i for w in split(t) for i in of(w)] + [model.end]
        before = np.array([model.end, *ids[:-1]])
        items, mask = contexts(c.of[before], np.zeros(len(ids), int))
        z = np.exp(np.stack([model.net.log_probs(items, mask, np.full(len(ids), k)) for k in range(c.count)], 1).astype(np.float64))
        p = mixed.part * z + (1 - mixed.part) * mixed.share[c.of[before]]
        edge = p[:, c.group < c.begin].sum(1)
        p = p[np.arange(len(ids)), c.of[ids]] * np.exp(mixed.inside[ids])
        total, k = 0.0, 0
        for w in split(t):
            n = len(of(w))
            rest = np.prod(p[k + 1 : k + n]) * edge[k + n]
            n_all, n_types, i = first_n[ids[k]], first_v[ids[k]], known.get(w, 0)
            total += np.log10(p[k] / edge[k]) + np.log10(max(i - 0.4, 0) / n_all + 0.4 * n_types / n_all * rest if n_all else rest)
            k += n
        total += np.log10(p[k] / edge[k])
        assert row["score"] == pytest.approx(total, rel=1e-3) and row["n_ids"] == len(ids) and row["n_tokens"] == len(split(t)) + 1


def test_counts_of_training_texts():
    model, _, _ = small_model()
    name = tokens.vocabulary_path(VOCABULARY)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 0], pa.int32()), pa.array([False, False, True]), pa.array(["the zebra the", "The", "zebra"])], ["chunk", "held", "text"])
    got = pa.Table.from_batches(list(lm_scoring._counted(model, name, [batch]))).to_pylist()
    tokenizer = tokens.SegmentEncoder(name).tokenizer
    streams = [[model.end, *(i for w in t.lower().split() for i in tokenizer.encode(" " + w, add_special_tokens=False).ids), model.end] for t in ("the zebra the", "The")]
    want = Counter((model.classes.of[a] * lm_scoring.CLASSES + model.classes.of[b]) for s in streams for a, b in zip(s, s[1:], strict=False))
    assert {r["h"]: r["n"] for r in got if r["kind"] == lm_scoring.PAIR} == want
    assert {r["h"]: r["n"] for r in got if r["kind"] == lm_scoring.ID} == Counter(i for s in streams for i in s[1:])
    assert sorted((r["chunk"], r["n"]) for r in got if r["kind"] == lm_scoring.WORD) == [(0, 1), (0, 2), (1, 1)]


def test_every_training_text_teaches(spark):
    """Two tables differ only in the order of words in late texts; the held-out text scores higher after those of its order."""
    got = []
    for order in ("left right left right ", "left left right right "):
        rows = [(i, "left right left left right right " * 10, False) for i in range(20)] + [(100 + i, order * 40, False) for i in range(60)] + [(5000, "left right " * 20, True)]
        got.append(lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), F.col("held")).where("held_out").first())
    assert got[0]["score"] > got[1]["score"] and got[0]["base_score"] == got[1]["base_score"]


def test_every_training_id_has_a_lesson(spark, docs, monkeypatch):
    """Whatever the corpus's size, each id and end of each text is learned from, and its last lesson counts for the mixing weight once."""
    name = tokens.vocabulary_path(VOCABULARY)
    tokenizer = tokens.SegmentEncoder(name).tokenizer
    texts = docs.selectExpr("doc_id id", "text")
    want = sum(1 + sum(len(tokenizer.encode(" " + w, add_special_tokens=False).ids) for w in split(r["text"])) for r in texts.collect())
    for least, size in ((1, 3000), (10**9, 10**9)):
        monkeypatch.setattr(lm_scoring, "LEAST_IDS", least)
        monkeypatch.setattr(lm_scoring, "TASK_IDS", size)
        model, runs, counts = lm_scoring.classes_of(texts, name)
        k = model.classes.count
        before = model.net.p["u"].copy()
        lm_scoring.fit(model, runs, int(counts.sum()), np.ones((k, k)))
        assert counts.sum() == model.odds.sum() == want and (model.net.p["u"] != before).any()


def test_lessons_by_windows_are_the_plain_gradients():
    model, _, _ = small_model()
    rng = np.random.default_rng(8)
    row, y = (rng.integers(0, model.classes.count, 300) for _ in range(2))
    text = np.sort(rng.integers(0, 9, 300))
    items, mask = contexts(row, text)
    want, (got, chance) = model.net.gradients(items, mask, y), model.net.lesson(row, text, y)
    assert want.keys() == got.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert np.allclose(np.log(chance), model.net.log_probs(items, mask, y), atol=1e-4)


def test_held_out_texts_score_above_the_base(spark):
    got = lm_scoring.lm_of_all(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got["s"] / got["n"] > got["b"] / got["n"]


def test_substrings(spark, docs, none):
    rows = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs.where("doc_id <> 13")).collect()}
    assert rows[9]["repeats_of"] == [8] and "Shared" not in rows[9]["kept_text"] and rows[8]["removed"] == []
    x = rows[9]
    kept, at = "", 0
    for s in x["removed"]:
        kept, at = kept + x["text"][at : s["start"]], s["stop"]
    assert kept + x["text"][at:] == x["kept_text"]
    assert rows[3]["kept_text"] is None and rows[15]["removed"] == [] and rows[6]["removed"] == []
    assert substring_dedup.remove_repeats(docs).count() == docs.count()
    assert substring_dedup.substrings_of_all(none).count() == 0
    assert substring_dedup.bands(75, 0.98) == (5, 2)


def test_band_tuning():
    for percent, recall in ((75, 0.98), (75, 0.9), (50, 0.95), (90, 0.99)):
        n, rows = substring_dedup.bands(percent, recall)
        assert (rows > 1 or percent < 75) and 1 - (1 - (percent / 100) ** rows) ** n >= recall > 1 - (1 - (percent / 100) ** rows) ** (n - 1)


def test_removed_words_against_exact_runs(spark):
    """Runs of 25 words or more that an earlier document holds word for word lose nine tenths of their words."""
    rows = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).collect()}
    size, seen, repeated, removed, long, lost = substring_dedup.RUN_WORDS, set(), 0, 0, 0, 0
    for i in sorted(rows):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), rows[i]["text"] or ""))]
        grams = [tuple(w[2] for w in words[k : k + size]) for k in range(len(words) - size + 1)]
        marked = {j for k, g in enumerate(grams) if g in seen for j in range(k, k + size)}
        gone = {j for j, (a, e, _) in enumerate(words) if any(x["start"] <= a and e <= x["stop"] for x in rows[i]["removed"])}
        repeated, removed = repeated + len(marked), removed + len(marked & gone)
        for j in sorted(marked):
            if j - 1 not in marked:
                stop = next(k for k in range(j, len(words) + 1) if k not in marked)
                if stop - j > 50:
                    long, lost = long + 1, lost + (not any(k in gone for k in range(j, stop)))
        seen.update(grams)
    assert removed >= 0.9 * repeated > 0 and lost <= 0.02 * long


def test_runs_grow_into_glued_paragraphs(spark):
    """A passage whose first and last sentences are glued to other words is cut at its own words."""
    inner = "Seven grey herons stood along the narrow bank. The water moved under them without any sound"
    rows = [(1, f"Alpha beta said that early on {inner} while gamma delta went home. Then nothing."), (2, f"Other people noted that early on {inner} while gamma delta slept. Quite another end."), (3, None), (4, "")]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), run_words=20).collect()}
    assert got[1]["kept_text"] == rows[0][1] and got[3]["kept_text"] is None
    more = "One full sentence of ten plain words stands right here."
    rows = [(i, f"{a} seen before noon {inner}. {more} It ended as it had begun {b}.") for i, a, b in ((1, "Alpha beta were", "quietly"), (2, "Others have been", "loudly"))]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["kept_text"] == "Others have been  loudly." and got[2]["repeats_of"] == [1]


def test_paragraph_recall_against_all_pairs(spark):
    """Edited sentences: of all pairs of documents with paragraphs of Jaccard 0.75 or more, the marks find nine tenths or more, and nothing else."""
    rng = np.random.default_rng(21)
    base = [[f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(14, 40)))] for _ in range(60)]
    rows = []
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        for k in range(3):
            v = list(w)
            for _ in range(k):
                v[int(rng.integers(0, len(v)))] = f"e{rng.integers(0, 10**6)}"
            rows.append((1000 + 10 * i + k, " ".join(v)))
    grams = {i: frozenset(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)) for i, t in rows}
    root = {i: i for i in grams}
    ids = sorted(grams)
    for _ in range(3):
        for i in ids:
            for j in ids:
                if 100 * len(grams[i] & grams[j]) >= 75 * len(grams[i] | grams[j]):
                    root[i] = root[j] = min(root[i], root[j])
    want = {(i, r) for i, r in root.items() if i != r}
    got = {(r["id"], r["first_id"]) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(want) > 60
    assert {i for i, _ in got} <= {i for i, _ in want}


def test_verses_of_short_lines_repeat(spark):
    """Lines of under five words are found where they follow each other in the same earlier document, and left alone where they are met singly."""
    words = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    verse = "\n".join(f"line {k} of song" for k in range(20))
    rows = [(1, words("a", 40) + "\n" + verse + "\n" + words("b", 40)), (2, words("c", 40) + "\n" + verse + "\n" + words("d", 40)), (3, words("e", 40) + "\nline 3 of song\n" + words("f", 40)), (4, "line 5 of song")]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "song" not in got[2]["kept_text"] and got[2]["repeats_of"] == [1] and "c39" in got[2]["kept_text"] and "d0" in got[2]["kept_text"]
    assert all(got[i]["kept_text"] == t for i, t in rows if i != 2)


def test_paragraph_links_against_all_pairs():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 40, 12).astype(np.uint64)) for _ in range(60)]
    t = pa.table({"unit": np.arange(60), "chunk": np.zeros(60, np.int32), "c1": np.zeros(60, np.int64), "c2": np.zeros(60, np.int64), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    out = substring_dedup._verify(40)(t)
    pairs = [(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 40 * len(np.union1d(sets[a], sets[b]))]
    root = lambda p: graph.union_find(np.array([a for a, _ in p], int), np.array([b for _, b in p], int), 60).tolist()
    assert root(pairs) == root(list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))) and pairs


def test_media(docs, none):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in media.media_digest(docs).collect())
    want = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        file = media.write_avi(np.frombuffer(raw, np.uint8))
        want[r["doc_id"], len((r["text"] or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(file), hashlib.sha256(file).hexdigest()] += 1
    assert got == want
    for raw in (b"", b"a", "é\n".encode() * 9000, bytes(range(256)) * 17):
        padded = np.zeros(max(64, -(-len(raw) // 64) * 64), np.uint8)
        padded[: len(raw)] = np.frombuffer(raw, np.uint8)
        file = media.write_avi(padded)
        assert media.read_back(file)[0] == padded.tobytes()
        assert media.read_avi(file).payload == len(padded)
    assert media.media_digest(none).count() == 0
    assert media.clips(none.selectExpr("doc_id media_id", "cast(null as binary) media")).count() == 0


def test_damaged_files_give_a_row_of_nulls(spark):
    good = media.write_avi(np.arange(6400, dtype=np.uint8))
    rows = [(1, bytearray(good)), (2, bytearray(b"RIFFxx")), (3, bytearray(good[: len(good) // 2])), (4, None), (5, bytearray(b"")), (6, bytearray(b"no file at all, just text"))]
    got = media.clips(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert {r["media_id"] for r in got if r["clip"] is not None} >= {1}
    assert {r["media_id"] for r in got if r["clip"] is None} >= {2, 6} and not {4, 5} & {r["media_id"] for r in got}


def test_shots_and_general_frames(spark):
    """Frames of the general decoder (several symbols, no restarts) and a cut between dark and bright runs."""
    rng = np.random.default_rng(8)

    def flat_frame(level):  # DC only: category 3 code 0, category 0 code 10, end of block code 0
        head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([64] * 64)) + media._segment(0xC0, bytes([8, 0, 16, 0, 16, 1, 1, 0x11, 0])) + media._segment(0xC4, bytes([0, 1, 1]) + bytes(14) + bytes([3, 0])) + media._segment(0xC4, bytes([0x10, 1]) + bytes(15) + b"\x00") + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
        value = level if level > 0 else level + 7
        bits = "0" + f"{value:03b}" + "0" + ("10" + "0") * 3
        bits += "1" * (-len(bits) % 8)
        return head + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)) + b"\xff\xd9"

    dark, bright = media.decode_jpeg(flat_frame(-7)), media.decode_jpeg(flat_frame(7))
    assert dark.shape == (16, 16) and dark.max() < 80 and bright.min() > 170
    noise = lambda x: np.clip(x.astype(int) + rng.integers(0, 3, x.shape), 0, 255).astype(np.uint8)
    assert media.shots([noise(dark) for _ in range(5)] + [noise(bright) for _ in range(4)]) == [(0, 5), (5, 9)]
    assert media.shots([dark, bright]) == [(0, 1), (1, 2)] and media.shots([dark, noise(dark)]) == [(0, 2)]


def test_mixing(spark, docs, none):
    got = mixing.mix_sources(docs, budget=0.7).toPandas()
    assert len(got) == docs.count() and got["probability"].between(0, 1).all()
    total = got["n_tokens"].sum()
    assert (got["probability"] * got["n_tokens"]).sum() / total == pytest.approx(0.7, abs=1e-6)
    assert mixing.mix_sources(none).count() == 0
    blank = docs.withColumn("text", F.lit(" "))
    assert mixing.mix_sources(blank).where("kept").count() == docs.count()


def test_mixing_on_both_sides_of_the_cell_limit(spark):
    """The driver's raking and the joined one give the same probabilities, defaults and given targets alike."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("source", F.expr("if(doc_id % 3 = 0, null, source <=> 'src1')"))
    for given in (None, {"lang": {"en": 0.6, "de": 0.2, "fr": 0.1, "es": 0.1}}):  # the same rule of ending; a few rounds show it
        near, far = (mixing.plan_mixture(table, given=given, topics=2, local_cells=n, rounds=3, tries=1) for n in (10_000, 0))
        a, b = (m.cells.toPandas().sort_values(list(mixing.MARGINS), ignore_index=True) for m in (near, far))
        assert np.allclose(a["probability"], b["probability"], atol=1e-9) and near.budget == pytest.approx(far.budget, abs=1e-12)


def test_expected_shares_meet_their_targets(spark):
    """On the probabilities that decide, not on weights before them."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for given in (None, {"source": {f"src{i}": 3.0 if i == 4 else 1.0 for i in range(20)}}):
        m = mixing.plan_mixture(table, given=given)
        got = m.margins.toPandas()
        assert (got["target"] - got["expected"]).abs().max() < 1e-6 and m.gap < 1e-7
        assert (got["target"] - got["present"]).abs().max() > 1e-3
    rows = mixing.mix_sources(table, mixture=m).toPandas()
    expected = (rows["n_tokens"] * rows["probability"]).groupby(rows["source"]).sum()
    assert (expected / expected.sum())["src4"] == pytest.approx(3 / 22, abs=1e-6)
    kept = rows[rows["kept"]].groupby("source")["n_tokens"].sum()
    assert abs((kept / kept.sum() - expected / expected.sum()).max()) < 0.05


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_default_targets_take_the_whole_budget(spark, size):
    m = mixing.plan_mixture(spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet"))
    assert m.budget == 0.8 and m.gap < 1e-6


def test_raking_decides_the_default_mixture(spark, monkeypatch):
    """Without the raking stage the probabilities are others, and the targets are missed."""
    table, rake = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), mixing.rake
    cells = lambda m: m.cells.toPandas().sort_values(list(mixing.MARGINS), ignore_index=True)["probability"].to_numpy()
    raked = cells(mixing.plan_mixture(table))
    monkeypatch.setattr(mixing, "rake", lambda codes, tokens, x, goals, *more: rake(codes, tokens, x, goals, *more) if len(codes) == 1 else (x, 0.0))
    plain = mixing.plan_mixture(table)
    margins = plain.margins.toPandas()
    assert np.abs(cells(plain) - raked).max() > 0.02 and (margins["target"] - margins["expected"]).abs().max() > 1e-3


def test_word_counts_are_not_cut_off():
    text = b"again " * 70_000 + b"other"
    n, counts = mixing.word_counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert n[0] == 70_001 and sorted(counts[0][counts[0] > 0].tolist()) == [1, 70_000]
    rows = np.stack([np.minimum(counts[0], most) for most in (200, 60_000, 1 << 20)])
    assert (mixing._matrix(pa.array([mixing._packed(x) for x in rows])) == rows).all()


def test_contradicting_targets_report_their_gap(spark):
    rows = [(i, "alpha beta gamma " * 5, "en" if i < 6 else "de", "a" if i < 6 else "b") for i in range(10)]
    m = mixing.plan_mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), given={"lang": {"en": 0.5, "de": 0.5}, "source": {"a": 0.9, "b": 0.1}})
    assert m.gap > 0.05


def test_raking_against_a_plain_version():
    """Same margins as unbounded raking where no cell is full; no cell gives more than it has, and margins hold at p <= 1."""
    rng = np.random.default_rng(9)
    codes, tokens_ = [rng.integers(0, k, 200) for k in (5, 3, 4)], rng.integers(1, 100, 200).astype(float)
    targets = [rng.dirichlet(np.ones(k) * 40) for k in (5, 3, 4)]
    total = tokens_.sum()
    x, gap = mixing.rake(codes, tokens_, 0.2 * tokens_, [0.2 * total * t for t in targets])
    w = 0.2 * tokens_
    for _ in range(300):
        for c, t in zip(codes, targets, strict=True):
            w = w * (0.2 * total * t / np.bincount(c, w))[c]
    assert gap < 1e-7 and np.allclose(x, w, rtol=1e-4) and (w < tokens_).all()
    q = tokens_ * np.where(codes[0] == 0, 1.0, rng.uniform(0.1, 0.6, 200))  # margins that only full cells of one category can meet
    x, gap = mixing.rake(codes, tokens_, 0.5 * tokens_, [np.bincount(c, q) for c in codes])
    assert gap < 1e-7 and (x <= tokens_).all() and np.allclose(x[codes[0] == 0], tokens_[codes[0] == 0], rtol=1e-4)
    for c in codes:
        assert np.allclose(np.bincount(c, x), np.bincount(c, q), rtol=1e-5)


def test_topics_gather_texts_by_their_words(spark):
    one, two = "orbit planet rocket star comet lunar".split(), "butter flour oven sugar recipe dough".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.permutation(one if i % 2 else two)) + f" word{i}", "en", "s") for i in range(60)] + [(60, None, "en", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["topic"] for r in mixing.mix_sources(table, topics=2).collect()}
    assert got[60] == -1 and len({got[i] for i in range(0, 60, 2)}) == len({got[i] for i in range(1, 60, 2)}) == 1 and got[0] != got[1]


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = c.stash(stage(spark, docs, SMALL))
        assert docs.columns == c.COLUMNS, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert c.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct().count() == docs.count()
    assert not set(docs.select("doc_id").distinct().collect()) - set(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())


def test_pipeline_stages_on_awkward_rows(spark, docs, none):
    """Nulls, empty and very long texts, repeated rows and ids, clashing extra columns, and an empty table."""
    import corpus_pipeline as c

    table = docs.unionByName(docs.where("doc_id in (1, 6) or doc_id is null"))  # exact repeats of three rows
    labelled = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 1000)
    table = table.withColumn("lang", F.lit(None).cast("string")).unionByName(labelled, allowMissingColumns=True)
    told = c.language_stage(spark, table, SMALL)
    assert told.columns == c.COLUMNS and told.where("text is null or trim(text) = '' or lang is null").count() == 0
    joined = c.ngram_join_stage(spark, table, SMALL).collect()
    ids = [r["doc_id"] for r in joined]
    assert sorted(i for i in ids if i is not None and i < 1000) == [0, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 13, 15] and ids.count(None) == 1
    cut = {r["doc_id"]: r for r in c.substring_stage(spark, table, SMALL).collect()}
    assert cut[3]["text"] is None and cut[8]["text"].count("Shared") == 7 and "Shared" not in cut[9]["text"] and cut[9]["n_chars"] == len(cut[9]["text"])
    mixed = c.mixing_stage(spark, table, SMALL)
    assert mixed.columns == c.COLUMNS and 0 < mixed.count() <= table.count()
    packed = c.packing_stage(spark, table, SMALL)
    assert packed.select("doc_id").where("doc_id is not null").distinct().count() == table.select("doc_id").where("doc_id is not null").distinct().count()
    for _, stage in c.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_equal_rows_leave_one(spark):
    import corpus_pipeline as c

    row = lambda i, t: (i, t, "en", "s", len(t))
    table = spark.createDataFrame([row(1, "x y z"), row(1, "x y z"), row(2, "x y z"), row(1, "other"), row(None, "n"), row(None, "n")], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in c.ngram_join_stage(spark, table, SMALL).collect())
    assert got == [(0, "n"), (1, "other"), (1, "x y z")]
