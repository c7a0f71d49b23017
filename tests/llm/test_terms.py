import random

import pytest

from loresift.llm.terms import DOCS, marked_terms, python_counts, term_counts

SCHEMA = "doc_id long, text string, term string, h long"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["The", "it's", "a", "x-ray", "Café", "'tis", "日本", "don''t"] + ["".join(rng.choices("abcdefg'", k=rng.randint(1, 6))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "   ", "the the The", "the the The", "b" * 50_000]


@pytest.mark.parametrize("leaf_rows", [4_000_000, 40])
def test_counts_equal_plain_count(spark, texts, leaf_rows):
    """Also with leaves so small that every partition is split several times."""
    got = {r.term: (r.occurrences, r.documents) for r in term_counts(frame(spark, texts), leaf_rows=leaf_rows, bits=2).collect()}
    assert got.pop(DOCS) == (0, sum(t is not None for t in texts))
    assert got == python_counts(texts)


def test_marks(spark):
    texts = ["common rare"] + ["common odd odd"] * 2 + [""] * 2 + [None] * 5
    got = {r.term: r.mark for r in marked_terms(frame(spark, texts)).collect()}
    assert got == {"common": "rare", "rare": "rare", "odd": None}  # 3 of 5 texts, yet below 4 occurrences
    got = {r.term: r.mark for r in marked_terms(frame(spark, [*texts, "common"])).collect()}
    assert got["common"] == "common" and got["odd"] is None


def test_empty(spark):
    assert marked_terms(frame(spark, [None])).count() == 0
    assert marked_terms(frame(spark, ["x"]).limit(0)).count() == 0


def test_little_memory(spark, tmp_path, monkeypatch):
    """Far more distinct terms than 20 MB hold, texts longer than what is counted at a time, and no file
    anywhere but in the shared folder."""
    from loresift.llm import terms

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(250_000)]
    texts = [" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)] * 2 + [" ".join(words[:50_000])]
    monkeypatch.chdir(tmp_path)
    got = {r.term: (r.occurrences, r.documents) for r in term_counts(frame(spark, texts), memory_mb=20).collect()}
    assert got.pop(DOCS) == (0, len(texts)) and got == python_counts(texts)
    assert not list(tmp_path.iterdir())
    cut = [(t["text"].to_pylist(), whole, last) for t, whole, last in terms._pieces(terms.pa.RecordBatch.from_pydict({"text": ["a b", "", "it's " * 4, "c"]}), 9)]
    assert "".join("".join(t) for t, _, _ in cut) == "a b" + "it's " * 4 + "c" and [w for _, w, _ in cut] == [True, False, False, False, True]
    assert all(not (a[0][-1][-1:].isalpha() and b[0][0][:1].isalpha()) for a, b in zip(cut, cut[1:]) if not a[1] and not b[1])
