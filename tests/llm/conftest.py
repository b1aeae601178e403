import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A table with nulls, empties, ties, copies, near copies, a shared passage, a very long text and clashing extra columns."""
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 9973}" for i in range(n))
    passage = ". ".join("Shared " + words(900 + k, 9) for k in range(7)) + "."
    base = words(1, 120)
    rows = [(0, base), (1, base), (2, base.replace("w31", "x31", 1) + " tail"), (3, None), (4, ""), (5, "  \n "), (6, "One two"), (7, "one TWO"), (8, words(2, 200) + ". " + passage + " " + words(3, 50)), (9, words(4, 90) + ". " + passage + " " + words(5, 40)), (10, "é" * 50 + " ünï " + "日本語 テキスト. " * 20), (11, words(6, 30_000)), (12, "a.b!c? 'tis  double  spaced\n\nlines\t<|endoftext|> it's"), (13, "!!! 123 ???"), (13, "same id, another text"), (None, base), (15, words(7, 12))]
    rows = [(i, t, "en" if i is None or i % 3 else None, f"s{(i or 0) % 2}", len(t or ""), "x", 7) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, start int").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
