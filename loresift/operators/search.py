"""Ranked Boolean search: one query or many become one plan over the postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from .index import Index
from .query import fold, holds_without_terms, query_terms, tree

TITLE_BOOST, URL_BOOST = 0.35, 0.15
#: Terms per word of a mask.
WORD = 60
#: Largest list of query terms that is sent to every executor.
BROADCAST_BYTES = 16 << 20


def _predicate(node, flag, everything: Column) -> Column:
    found = fold(node, flag, everything, lambda a, b: a & b, lambda a, b: a | b, lambda a, b: a & ~b)
    return F.lit(False) if found is None else found


def matches(index: Index, query: str, scored: bool = False) -> DataFrame:
    """``doc_id, url, title, doc_len, tf_0, tf_1, ...`` of the matching documents, and ``df_0, df_1, ...`` if
    they are to be scored.

    The postings of the query's terms are grouped by document once; the query is a predicate over
    the presence of terms. Only a query that can match without any term starts from all documents.
    """
    terms, node = query_terms(query), tree(query)
    asked = F.col("term").isin(terms) if terms else F.lit(False)
    hits = index.postings.where(asked)
    if scored:  # as many rows of the vocabulary as the query has terms
        hits = hits.join(F.broadcast(index.vocabulary().where(asked)), "term")
    columns = [F.max(F.when(F.col("term") == t, F.col(c))).alias(f"{c}_{k}") for k, t in enumerate(terms) for c in ("tf", "df")[: 1 + scored]]
    hits = hits.groupBy("doc_id").agg(*columns or [F.count(F.lit(1)).alias("none")])
    docs = index.docs.join(hits, "doc_id", "left" if holds_without_terms(node) else "inner")
    return docs.where(_predicate(node, lambda t: F.col(f"tf_{terms.index(t)}").isNotNull(), F.col("url") != ""))


def _weight(tf: Column, df: Column, size: int, term: Column) -> Column:
    idf = F.ln(F.lit(size + 1.0) / (df + 1.0)) + 1.0
    boost = F.when(ascii_lower(F.col("title")).contains(term), TITLE_BOOST).otherwise(0.0) + F.when(ascii_lower(F.col("url")).contains(term), URL_BOOST).otherwise(0.0)
    return F.when(tf > 0, (1 + F.ln(tf)) * idf + boost).otherwise(F.lit(0.0))


def search(index: Index, query: str, limit: int = 100) -> DataFrame:
    """``rank, doc_id, url, title, score`` of the best documents, ties by id."""
    terms = query_terms(query)
    weights = [_weight(F.col(f"tf_{k}"), F.col(f"df_{k}"), index.size(), F.lit(t)) for k, t in enumerate(terms)]
    total = reduce(lambda a, b: a + b, weights, F.lit(0.0))
    score = F.when(F.col("doc_len") > 0, total / F.sqrt(F.col("doc_len").cast("double"))).otherwise(total)
    best = matches(index, query, scored=True).select("doc_id", "url", "title", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "url", "title", "score")


def count_matches(index: Index, query: str) -> DataFrame:
    """One row: ``matches``, before any limit."""
    return matches(index, query).agg(F.count(F.lit(1)).alias("matches"))


def scored_many(index: Index, queries: dict[int, str]) -> DataFrame:
    """``qid, doc_id, score`` of all matches of many queries, in one pass over the postings.

    The driver knows the queries (a bounded list by nature: it is the query log being evaluated), so
    terms and predicates are compiled into the plan. Queries that match without any term read all
    documents besides. The terms that a document holds are bits of as many words as the longest query
    needs.
    """
    spark = index.docs.sparkSession
    compiled = {q: (tree(text), query_terms(text)) for q, text in queries.items()}
    rows = [(int(q), t, k) for q, (_, terms) in compiled.items() for k, t in enumerate(terms)]
    words = max((k for _, _, k in rows), default=0) // WORD + 1
    asked = spark.createDataFrame(rows, "qid int, term string, k int").join(index.vocabulary(), "term")
    if sum(40 + len(t) for _, t, _ in rows) <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    hits = index.postings.join(asked, "term").join(index.docs, "doc_id")
    bit = F.expr(f"shiftleft(1L, k % {WORD})")
    masks = [F.when(F.expr(f"k div {WORD} = {n}"), bit).otherwise(F.lit(0)).cast("long").alias(f"mask_{n}") for n in range(words)]
    found = hits.select("qid", "doc_id", "url", "doc_len", *masks, _weight(F.col("tf"), F.col("df"), index.size(), F.col("term")).alias("w"))
    open_queries = [q for q, (node, _) in compiled.items() if holds_without_terms(node)]
    if open_queries:
        every = index.docs.select(
            F.explode(F.array(*map(F.lit, open_queries))).alias("qid"), "doc_id", "url", "doc_len", *[F.lit(0).cast("long").alias(f"mask_{n}") for n in range(words)], F.lit(0.0).alias("w")
        )
        found = found.unionByName(every)
    grouped = found.groupBy("qid", "doc_id").agg(
        F.first("url").alias("url"), F.first("doc_len").alias("doc_len"), F.sum("w").alias("w"), *[F.bit_or(f"mask_{n}").alias(f"mask_{n}") for n in range(words)]
    )
    keep = F.lit(False)
    for q, (node, terms) in compiled.items():
        flag = lambda t, at=terms.index: F.col(f"mask_{at(t) // WORD}").bitwiseAND(F.lit(1 << at(t) % WORD)) != 0
        keep = F.when(F.col("qid") == q, _predicate(node, flag, F.col("url") != "")).otherwise(keep)
    score = F.when(F.col("doc_len") > 0, F.col("w") / F.sqrt(F.col("doc_len").cast("double"))).otherwise(F.col("w"))
    return grouped.where(keep).select("qid", "doc_id", "url", F.round(score, 6).alias("score"))


def search_many(index: Index, queries: dict[int, str], limit: int = 100) -> DataFrame:
    """``qid, rank, doc_id, url, score``: the best ``limit`` of every query."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored_many(index, queries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "rank", "doc_id", "url", "score")
