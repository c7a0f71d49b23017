import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loresift.functions.stem import stem, stem_sql, stems, stems_by_sql
from loresift.functions.text import STOP_WORDS, occurrences, raw_tokens, tokenize
from loresift.operators import evaluate, query, search
from loresift.operators.index import Index, build_index, build_statistics, term_frequencies, tokens_of, zipf

STEMS = {
    "running": "run", "ponies": "poni", "national": "nation", "generalization": "gener", "effective": "effect", "relational": "relat", "caresses": "caress",
    "agreed": "agre", "played": "plai", "happy": "happi", "hopefulness": "hope", "probate": "probat", "one": "on", "vault's": "vault'", "dogs'": "dogs'",
    "controlling": "control", "rate": "rate", "cease": "ceas", "sky": "sky", "ing": "ing", "ies": "i", "oed": "o", "enclave": "enclav", "radiation": "radiat",
}


def test_stem_goldens():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_stem_expression_equals_python(spark):
    rng = random.Random(1)
    parts = ["a", "b", "y", "e", "l", "s", "t", "'", "ing", "ed", "ational", "ement", "ion", "ll", "ies", "z", "w", "x"]
    words = sorted({"".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(3000)} | set(STEMS))
    words = [w for w in words if w[0] != "'"]
    frame = spark.createDataFrame([(w,) for w in words], "token string")
    got = {r.token: r.stem for r in stems_by_sql(frame).collect()}
    assert got == {w: stem(w) for w in words} == {r.token: r.stem for r in stems(frame).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE v (token VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?)", [(w,) for w in words])
    assert dict(con.sql(stem_sql("v", "duckdb")).fetchall()) == got


def test_tokens(spark):
    texts = ["The pip-boy's vault's dogs' a' 'tis x café naïve 76 T-51b", None, "", "THE AND"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: (r.a, r.b) for r in rows.select("k", raw_tokens(F.col("t")).alias("a"), tokenize(F.col("t")).alias("b")).collect()}
    assert got[0][0] == ["the", "pip", "boy's", "vault's", "dogs'", "a'", "tis", "caf", "na", "ve"]
    assert got[0][1] == got[0][0][1:]
    assert got[1] == ([], []) and got[2] == ([], []) and got[3] == (["the", "and"], [])
    assert all(tokens_of(t or "") == got[k][1] for k, t in enumerate(texts))
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 107


A, B, C = query.Leaf("a"), query.Leaf("b"), query.Leaf("c")
ALL = query.Everything()
RULES = {
    "a b": B, "a b and c": query.And(B, C), "( a b ) and c": query.And(B, C), "a not b": query.Minus(A, B), "not a": query.Minus(ALL, A),
    "not not a": query.Minus(ALL, query.Minus(ALL, A)), "a and not b": query.Minus(A, B), "a or not b": query.Minus(A, B),
    "a or ( not b )": query.Minus(A, B), "not a and b": query.And(query.Minus(ALL, A), B), "not a or not b": query.Minus(query.Minus(ALL, A), B),
    "a and b or c": query.Or(query.And(A, B), C), "a or b and c": query.Or(A, query.And(B, C)), "a or b not c": query.Or(A, query.Minus(B, C)),
    "a and b not c": query.And(A, query.Minus(B, C)), "( a or b ) not c": query.Minus(query.Or(A, B), C), "a not b not c": query.Minus(A, query.Minus(B, C)),
    "a not not b": query.Minus(ALL, query.Minus(A, B)), "not ( a or b )": query.Minus(ALL, query.Or(A, B)), "( a or b": query.Or(A, B),
    "( a or b ) and c": query.And(query.Or(A, B), C), "a or b ) and c": query.And(query.Or(A, B), C), "a and": A, "or a": A, "and": None, "not": None, "": None,
}


@pytest.mark.parametrize("text", RULES)
def test_algebra(text):
    assert query.tree(text) == RULES[text]


def test_lexer():
    assert query.lex("Café AND, (pip-boy NOT 'tis) ??") == ["caf", "and", "(", "pip-boy", "not", "'tis", ")"]
    assert query.query_terms("vaults NOT vault OR running") == ["vault", "run"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "and", "or", "not", "(", ")"]), max_size=9))
def test_flags_equal_sets(tokens):
    """A predicate over term flags selects what set operators over posting lists select."""
    node = query.tree(" ".join(tokens))
    docs = {k: {t for j, t in enumerate("abc") if k >> j & 1} for k in range(8)}
    lists = {t: {k for k, own in docs.items() if t in own} for t in "abc"}
    sets = query.fold(node, lambda t: lists[t], set(docs), lambda x, y: x & y, lambda x, y: x | y, lambda x, y: x - y)
    flags = {k for k, own in docs.items() if query.fold(node, lambda t, own=own: t in own, True, lambda x, y: x and y, lambda x, y: x or y, lambda x, y: x and not y)}
    assert flags == (sets or set())


PAD = " filler words that are long enough to pass the limit of fifty bytes"


@pytest.fixture(scope="module")
def small_index(spark):
    rows = [
        (0, "u/reactor", "Reactor", "reactor shelter reactor" + PAD), (1, "u/1", None, "reactor drone" + PAD), (2, None, "Shelter", "shelter" + PAD),
        (3, "", "Drone", "drone drone shelter" + PAD), (5, "u/5", "Nothing", "unrelated" + PAD), (6, "u/6", "short", "reactor"), (7, "u/7", "none", None),
    ]
    documents = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, url string, title string, text string, term string")
    return documents, build_index(documents)


def test_index_invariants(small_index):
    documents, index = small_index
    docs = {r.doc_id: r.doc_len for r in index.docs.collect()}
    rows = index.postings.collect()
    assert set(docs) == {0, 1, 2, 3, 5}
    assert sum(r.tf for r in rows) == sum(docs.values())
    assert sum(r.df for r in index.vocabulary().collect()) == len(rows)
    assert index.size() == 6
    stats = build_statistics(documents, term_frequencies(documents)).first()
    assert stats.tokens == sum(docs.values()) and stats.documents == 5 and stats.vocabulary == index.vocabulary().count()
    top = zipf(term_frequencies(documents), 3).collect()
    assert [r.rank for r in top] == [1, 2, 3] and top[0].frequency >= top[1].frequency >= top[2].frequency


def test_search(small_index, tmp_path, spark):
    _, index = small_index
    ids = lambda q: {r.doc_id for r in search.matches(index, q).collect()}
    assert ids("reactor AND shelter") == {0}
    assert ids("shelter NOT drone") == {0, 2}
    assert ids("NOT reactor") == {5}  # documents without url are in no complement
    assert ids("") == set() and ids("the AND reactor") == set()
    ranked = search.search(index, "reactor OR shelter").collect()
    assert [r.rank for r in ranked] == list(range(1, 5)) and ranked[0].doc_id == 0
    assert search.count_matches(index, "reactor OR shelter").first().matches == 4
    many = search.search_many(index, {1: "reactor OR shelter", 2: "NOT reactor", 3: "zzz"}).collect()
    assert [(r.doc_id, r.score) for r in sorted(many, key=lambda r: (r.qid, r.rank)) if r.qid == 1] == [(r.doc_id, r.score) for r in ranked]
    assert [r.doc_id for r in many if r.qid == 2] == [5] and not [r for r in many if r.qid == 3]
    index.save(str(tmp_path / "index"))
    loaded = Index.load(spark, str(tmp_path / "index"))
    assert search.search(loaded, "reactor OR shelter").collect() == ranked


def test_metrics_golden(spark):
    run = spark.createDataFrame([(1, k + 1, d) for k, d in enumerate([1, 3, 5, 2, 8, 10, 4])], "qid int, rank int, key long")
    qrels = spark.createDataFrame([(1, d, g) for d, g in {1: 3, 2: 2, 3: 3, 4: 1, 5: 2}.items()], "qid int, key long, grade int")
    m = evaluate.metrics(run, qrels).first()
    for k, values in {5: (0.8, 14.2085, 0.9735, 0.9326), 10: (0.5, 14.5419, 0.9963, 0.9327), 20: (0.25, 14.5419, 0.9963, 0.9327)}.items():
        assert (round(m[f"p_{k}"], 4), round(m[f"dcg_{k}"], 4), round(m[f"ndcg_{k}"], 4), round(m[f"err_{k}"], 4)) == values
    ap = evaluate.average_precision(run, qrels).first().ap
    assert ap == round((1 + 1 + 1 + 1 + 5 / 7) / 5, 6)


def test_qrels_dirt(spark):
    rows = [(1, 5, "u", 2), (1, 5, "u", 3), (1, None, "v", 1), (1, 6, None, None), (None, 7, "w", 1), (2, 9, "x", 0)]
    qrels = spark.createDataFrame(rows, "qid int, doc_id long, url string, grade int")
    clean = evaluate.clean_qrels(qrels, "doc_id")
    assert sorted(map(tuple, clean.collect())) == [(1, 5, 3), (2, 9, 0)]
    cover = evaluate.coverage(clean, spark.createDataFrame([(5,)], "key long"))
    assert sorted(map(tuple, cover.collect())) == [(1, 1, 1, 1.0), (2, 1, 0, 0.0)]
    assert evaluate.coverage_summary(cover).first().micro_coverage == 0.5


def test_grades(spark):
    docs = spark.createDataFrame([(1, "Reactor", "reactor " * 10), (2, "other", "reactor " * 5), (3, None, None), (4, "x", "reactor drone " * 3)], "doc_id long, title string, text string")
    got = {(r.qid, r.doc_id): r.grade for r in evaluate.grade_documents(docs, {1: "reactor", 2: "reactor AND drone", 3: "reactor NOT x"}).collect()}
    assert got[(1, 1)] == 3 and got[(1, 2)] == 1 and got[(2, 4)] == 1
    assert got[(3, 1)] == 3 and (3, 4) not in got and (3, 3) not in got
    assert docs.select(occurrences(F.lit("aaaa"), "aa").alias("n")).first().n == len(re.findall("aa", "aaaa"))


def test_long_queries_in_a_batch(spark):
    """More terms than one word of a mask holds, with a NOT beyond it."""
    words = ["".join(chr(97 + (k // 26**p) % 26) for p in (2, 1, 0)) + "zor" for k in range(70)]
    rows = [(0, "u0", "t", " ".join(words)), (1, "u1", "t", " ".join(words[:69]) + " filler word of some length"), (2, "u2", "t", " ".join(words[5:]) + " " + words[64])]
    index = build_index(spark.createDataFrame(rows, "doc_id long, url string, title string, text string"))
    both = {1: " AND ".join(words[:69]), 2: " OR ".join(words) + " NOT " + words[69], 3: words[64] + " NOT " + words[0]}
    got = {}
    for r in search.search_many(index, both).collect():
        got.setdefault(r.qid, {})[r.doc_id] = r.score
    for qid, query in both.items():
        assert got.get(qid, {}) == {r.doc_id: r.score for r in search.search(index, query).collect()}
    assert set(got[1]) == {0, 1} and set(got[3]) == {2}


def test_size_of_small_indexes(spark, tmp_path):
    schema = "doc_id long, url string, title string, text string"
    text = "a generator below the eastern wall of the northern dam"
    one = build_index(spark.createDataFrame([(0, "u", "t", text)], schema))
    assert one.size() == 1 and build_index(spark.createDataFrame([], schema)).size() == 0
    one.save(f"{tmp_path}/index")
    loaded = Index.load(spark, f"{tmp_path}/index")
    row = loaded.statistics().first()
    assert (row["size"], row.documents, row.postings, row.vocabulary) == (1, 1, 6, 6)
    assert search.search(loaded, "dam").collect() == search.search(one, "dam").collect()
