"""Retrieval evaluation: relevance grading, qrels, and rank metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences
from ..functions.urls import domain

CUTS = (5, 10, 20)
MAX_GRADE = 3


def parse_judged_query(query: str) -> tuple[list[str], list[str], str]:
    """``(wanted words, unwanted words, kind)`` of a query for grading; words as written, lower case."""
    wanted, unwanted, kind, negated = [], [], "SINGLE", False
    for word in query.split():
        name = word.upper()
        if name in ("AND", "NOT"):
            kind, negated = "AND", negated or name == "NOT"
        elif name == "OR":
            kind = "OR" if kind == "SINGLE" else kind
        else:
            (unwanted if negated else wanted).append(word.lower())
            negated = False
    return wanted, unwanted, kind


def grade(query: str, title: Column, text: Column) -> Column:
    """Relevance 0 to 3 of a document, from how often the query's words occur in title and text."""
    wanted, unwanted, kind = parse_judged_query(query)
    low_title, low_text = F.coalesce(F.lower(title), F.lit("")), F.coalesce(F.lower(text), F.lit(""))
    if not wanted:
        return F.lit(0)
    in_title = [low_title.contains(w) for w in wanted]
    counts = [occurrences(low_text, w) for w in wanted]
    titles = reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in in_title])
    least = counts[0] if len(counts) == 1 else F.least(*counts)
    most = counts[0] if len(counts) == 1 else F.greatest(*counts)
    present = reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in counts])
    if kind == "AND":
        level = F.when((titles == len(wanted)) & (least >= 3), 3).when((titles > 0) & (least >= 2), 2).when(least >= 2, 1).otherwise(0)
    elif kind == "OR":
        named = [F.when(t, c).otherwise(0) for t, c in zip(in_title, counts, strict=True)]
        best = named[0] if len(named) == 1 else F.greatest(*named)
        level = (
            F.when((titles >= 2) | ((titles >= 1) & (best >= 5)), 3)
            .when((titles >= 1) & (best >= 2), 2)
            .when((present >= 2) & (most >= 5), 2)
            .when((present >= 2) & (most >= 3), 1)
            .when(most >= 5, 1)
            .otherwise(0)
        )
    else:
        n, t = counts[0], in_title[0]
        level = F.when(t & (n >= 10), 3).when(t & (n >= 3), 2).when(n >= 15, 2).when(n >= 5, 1).otherwise(0)
    for word in unwanted:
        level = F.when(low_title.contains(word), 0).otherwise(level)
    return level.cast("int")


def grade_documents(documents: DataFrame, queries: dict[int, str]) -> DataFrame:
    """``qid, doc_id, grade`` of every query and document whose grade is not 0."""
    graded = F.array(*[F.struct(F.lit(int(q)).alias("qid"), grade(text, F.col("title"), F.col("text")).alias("grade")) for q, text in queries.items()])
    rows = documents.select("doc_id", F.explode(F.filter(graded, lambda g: g["grade"] > 0)).alias("g"))
    return rows.select("g.qid", "doc_id", "g.grade")


def grade_pool(documents: DataFrame, run: DataFrame, queries: dict[int, str]) -> DataFrame:
    """``qid, doc_id, grade``: like ``grade_documents``, of what each query retrieved only. Texts outside the
    pool are left out before they are graded."""
    pooled = documents.join(run.select("doc_id").distinct(), "doc_id", "left_semi")
    return grade_documents(pooled, queries).join(run.select("qid", "doc_id").distinct(), ["qid", "doc_id"])


def of_domain(run: DataFrame, qrels: DataFrame, source_domain: str) -> tuple[DataFrame, DataFrame]:
    """Results ``qid, rank, url`` and judgements ``qid, key, grade`` of one domain's urls, the results ranked
    anew as ``qid, rank, key``."""
    own = run.where((F.col("url") != "") & (domain(F.col("url")) == source_domain))
    ranked = own.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank"), F.col("url").alias("key"))
    return ranked, qrels.where(domain(F.col("key")) == source_domain)


def clean_qrels(qrels: DataFrame, key: str) -> DataFrame:
    """``qid, key, grade``: one judgement per query and key.

    Judgements without a key or grade are dropped; where several contradict, the highest counts.
    """
    known = qrels.where(F.col(key).isNotNull() & F.col("grade").isNotNull() & F.col("qid").isNotNull())
    return known.groupBy("qid", F.col(key).alias("key")).agg(F.max("grade").alias("grade"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``qid, rank, key, grade`` of a run ``(qid, rank, key)``; ``grade`` is null without judgement."""
    return run.join(qrels, ["qid", "key"], "left").select("qid", "rank", "key", "grade")


def ideal_gains(qrels: DataFrame, cuts=CUTS) -> DataFrame:
    """``qid, idcg_5, ...``, from judgements in order of their grade."""
    order = Window.partitionBy("qid").orderBy(F.desc("grade"), "key")
    ranked = qrels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(cuts))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    return ranked.groupBy("qid").agg(*[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"idcg_{k}") for k in cuts])


def metrics(run: DataFrame, qrels: DataFrame, cuts=CUTS) -> DataFrame:
    """Per query with at least one result: ``p_k, dcg_k, ndcg_k, err_k`` for each cut.

    A judged key counts for precision whatever its grade; the denominator is k.
    """
    seen = judged(run, qrels).where(F.col("rank") <= max(cuts))
    level = F.coalesce(F.col("grade"), F.lit(0))
    gain = (F.pow(F.lit(2.0), level) - 1) / F.log2(F.col("rank") + 1)
    stop = (F.pow(F.lit(2.0), level) - 1) / F.lit(float(2**MAX_GRADE))
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = seen.select("qid", "rank", "grade", gain.alias("gain"), stop.alias("stop"))
    rows = rows.withColumn("reach", F.coalesce(F.product(1 - F.col("stop")).over(before), F.lit(1.0)))
    at = lambda k, value: F.sum(F.when(F.col("rank") <= k, value).otherwise(0.0))
    sums = rows.groupBy("qid").agg(
        *[at(k, F.when(F.col("grade").isNotNull(), 1.0).otherwise(0.0)).alias(f"hits_{k}") for k in cuts],
        *[at(k, F.col("gain")).alias(f"dcg_{k}") for k in cuts],
        *[at(k, F.col("reach") * F.col("stop") / F.col("rank")).alias(f"err_{k}") for k in cuts],
    )
    joined = sums.join(ideal_gains(qrels, cuts), "qid", "left")
    columns = []
    for k in cuts:
        columns += [
            F.round(F.col(f"hits_{k}") / k, 6).alias(f"p_{k}"),
            F.round(f"dcg_{k}", 6).alias(f"dcg_{k}"),
            F.round(F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0), 6).alias(f"ndcg_{k}"),
            F.round(f"err_{k}", 6).alias(f"err_{k}"),
        ]
    return joined.select("qid", *columns)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row: the mean of every metric over the queries that returned something."""
    return per_query.agg(*[F.round(F.avg(c), 6).alias(c) for c in per_query.columns if c != "qid"])


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``qid, ap`` over the whole ranking, for queries that have judgements and results."""
    running = Window.partitionBy("qid").orderBy("rank")
    rows = judged(run, qrels).withColumn("hit", F.col("grade").isNotNull().cast("int"))
    rows = rows.withColumn("precision", F.sum("hit").over(running) / F.col("rank"))
    sums = rows.groupBy("qid").agg(F.sum(F.col("precision") * F.col("hit")).alias("s"))
    totals = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))
    return sums.join(totals, "qid").select("qid", F.round(F.col("s") / F.col("relevant"), 6).alias("ap"))


def mean_average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return average_precision(run, qrels).agg(F.round(F.avg("ap"), 6).alias("map"))


def coverage(qrels: DataFrame, keys: DataFrame) -> DataFrame:
    """``qid, relevant, covered, coverage``: how many judged keys the index (``key``) holds at all."""
    present = keys.where(F.col("key").isNotNull()).select("key").distinct().withColumn("present", F.lit(1))
    rows = qrels.join(present, "key", "left").groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"), F.count("present").alias("covered"))
    return rows.withColumn("coverage", F.round(F.col("covered") / F.col("relevant"), 6))


def coverage_summary(per_query: DataFrame) -> DataFrame:
    """One row: macro and micro coverage, and whether the macro value is below one half."""
    return per_query.agg(
        F.round(F.avg("coverage"), 6).alias("macro_coverage"),
        F.round(F.sum("covered") / F.sum("relevant"), 6).alias("micro_coverage"),
        (F.avg("coverage") < 0.5).alias("low"),
    )


def qrels_to_urls(qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """``qid, key, grade`` by url from judgements by document id; unknown or empty urls are dropped."""
    urls = docs.where(F.col("url") != "").select(F.col("doc_id").alias("key"), "url")
    return qrels.join(urls, "key").groupBy("qid", F.col("url").alias("key")).agg(F.max("grade").alias("grade"))


def grade_histogram(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("qid", "grade").agg(F.count(F.lit(1)).alias("n"))


def pool(run: DataFrame) -> DataFrame:
    """``doc_id`` of every document that any query returned."""
    return run.select("doc_id").distinct()
