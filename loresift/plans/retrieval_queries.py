"""Queries of text, index, search and evaluation operators, with their SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem_sql, stems
from ..functions.text import STOP_WORDS, tokenize
from ..operators import evaluate, search
from ..operators.index import Index, build_index, build_statistics, indexed, raw_token_rows, term_frequencies, token_counts, zipf
from ..operators.query import And, Everything, Leaf, Minus, Or, holds_without_terms, query_terms, tree
from ..session import file_state, staged, table, work_path
from ..sources import read_document_table, read_documents_jsonl, read_zipf_csv, write_document_table, write_documents_jsonl, write_metadata, write_qrels_json, write_zipf_csv

#: Boolean queries on words of the test collection, one for each rule of the algebra.
BOOLEAN = {
    "bool_and": "reactor AND shelter",
    "bool_or": "rifle OR helmet",
    "bool_not": "turret NOT drone",
    "bool_not_unary": "NOT reactor",
    "bool_paren": "(rifle OR helmet) AND shelter",
    "bool_juxtapose": "reactor shelter AND drone",
    "bool_not_chain": "turret NOT drone NOT reactor",
    "bool_precedence": "rifle OR reactor AND shelter",
}
RANKED = "reactor AND shelter"
DOMAIN = "lore00.kelashbritun.example"
#: Seventy terms: words of the collection, and the hours of a clock spelt as words.
MANY_TERMS = " OR ".join(
    ["reactor", "shelter", "rifle", "helmet", "quest", "courier", "radiation", "settler", "raider", "tunnel", "quarry", "turret", "convoy", "foundry"]
    + [f"{tens}{ones}" for tens in ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty") for ones in ("one", "two", "three", "four", "five", "six", "seven", "eight")]
) + " NOT drone"

_built: dict = {}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def index_of(spark: SparkSession, folder: str) -> Index:
    """The index of the folder's documents, written once per session and state of their files."""
    key = (spark.sparkContext.applicationId, folder, file_state(spark, f"{folder}/documents.parquet"))
    if key not in _built:
        _built[key] = build_index(documents(spark, folder)).stored(staged)
    return _built[key]


def query_log(spark: SparkSession, folder: str) -> dict[int, str]:
    """The logged queries; the log is a fixed, small table."""
    rows = table(spark, folder, "search_queries").where("qid IS NOT NULL AND query IS NOT NULL").collect()
    return {r.qid: r.query for r in sorted(rows)}


def _run(spark, folder):
    return search.search_many(index_of(spark, folder), query_log(spark, folder)).select("qid", "rank", F.col("doc_id").alias("key"))


def _qrels(spark, folder):
    return evaluate.clean_qrels(table(spark, folder, "qrels"), "doc_id")


def tokenize_docs(spark, folder):
    found = indexed(documents(spark, folder)).select("doc_id", tokenize(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("doc_len"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def token_positions(spark, folder):
    return raw_token_rows(documents(spark, folder))


def term_frequency(spark, folder):
    return token_counts(documents(spark, folder))


def stem_vocabulary(spark, folder):
    words = indexed(documents(spark, folder)).select(F.explode(tokenize(F.col("text"))).alias("token")).distinct()
    return stems(words)


def postings(spark, folder):
    return index_of(spark, folder).postings.select("term", "doc_id", "tf")


def doc_frequency(spark, folder):
    return index_of(spark, folder).vocabulary()


def idf_table(spark, folder):
    built = index_of(spark, folder)
    size = built.size()
    return built.vocabulary().select("term", F.round(F.ln(F.lit(size + 1.0) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def docs_table(spark, folder):
    return index_of(spark, folder).docs.select("doc_id", "url", "title", "doc_len")


def collection_frequency(spark, folder):
    return term_frequencies(documents(spark, folder))


def zipf_top(spark, folder):
    return zipf(term_frequencies(documents(spark, folder))).select("rank", "frequency", "term", F.round("theory", 6).alias("theory"))


def corpus_stats(spark, folder):
    return build_statistics(documents(spark, folder), staged(term_frequencies(documents(spark, folder)), "frequencies"))


def _boolean(query):
    def run(spark, folder):
        return search.matches(index_of(spark, folder), query).select("doc_id")

    return run


def ranked_search(spark, folder):
    return search.search(index_of(spark, folder), RANKED)


def ranked_search_batch(spark, folder):
    return search.search_many(index_of(spark, folder), query_log(spark, folder)).select("qid", "rank", "doc_id", "score")


def match_counts(spark, folder):
    scored = search.scored_many(index_of(spark, folder), query_log(spark, folder))
    return scored.groupBy("qid").agg(F.count(F.lit(1)).alias("matches"))


def result_pool(spark, folder):
    return evaluate.pool(search.search_many(index_of(spark, folder), query_log(spark, folder)))


def grade_docs(spark, folder):
    return evaluate.grade_documents(documents(spark, folder), query_log(spark, folder))


def grade_pool(spark, folder):
    run = search.search_many(index_of(spark, folder), query_log(spark, folder))
    return evaluate.grade_pool(documents(spark, folder), run, query_log(spark, folder))


def grade_histogram(spark, folder):
    return evaluate.grade_histogram(grade_docs(spark, folder))


def metrics_per_query(spark, folder):
    return evaluate.metrics(_run(spark, folder), _qrels(spark, folder))


def metrics_avg(spark, folder):
    return evaluate.mean_metrics(metrics_per_query(spark, folder))


def metrics_domain(spark, folder):
    """Metrics by url of one domain's results and judgements."""
    run = search.search_many(index_of(spark, folder), query_log(spark, folder))
    return evaluate.metrics(*evaluate.of_domain(run, evaluate.clean_qrels(table(spark, folder, "qrels"), "url"), DOMAIN))


def mean_ap(spark, folder):
    return evaluate.mean_average_precision(_run(spark, folder), _qrels(spark, folder))


def qrels_urls(spark, folder):
    return evaluate.qrels_to_urls(_qrels(spark, folder), index_of(spark, folder).docs)


def qrels_coverage(spark, folder):
    by_url = evaluate.clean_qrels(table(spark, folder, "qrels"), "url")
    return evaluate.coverage(by_url, index_of(spark, folder).docs.select(F.col("url").alias("key")))


def qrels_coverage_summary(spark, folder):
    return evaluate.coverage_summary(qrels_coverage(spark, folder))


def index_totals(spark, folder):
    return index_of(spark, folder).statistics()


def index_saved(spark, folder):
    """A search on an index that was saved and loaded."""
    path = work_path(spark, "saved")
    index_of(spark, folder).save(path)
    return search.search(Index.load(spark, path), RANKED)


def search_many_terms(spark, folder):
    """A batch with a query of more terms than a machine word has bits."""
    return search.scored_many(index_of(spark, folder), {1: MANY_TERMS, 2: RANKED}).select("qid", "doc_id", "score")


def jsonl_documents(spark, folder):
    """Documents written as JSON lines and read again."""
    path = work_path(spark, "jsonl")
    write_documents_jsonl(documents(spark, folder), path)
    return read_documents_jsonl(spark, path).select("doc_id", "url", "title", F.md5("text").alias("text_md5"))


def export_metadata(spark, folder):
    path = work_path(spark, "metadata")
    write_metadata(documents(spark, folder).withColumn("text_length", F.length("text")), path)
    return spark.read.parquet(path)


def document_table(spark, folder):
    """The table of ids, urls and titles, written and read again; empty fields are null."""
    path = work_path(spark, "table")
    write_document_table(index_of(spark, folder).docs, path)
    return read_document_table(spark, path)


def zipf_file(spark, folder):
    """The rank list up to rank 1,000, written with its header and read again."""
    path = work_path(spark, "zipf")
    write_zipf_csv(zipf(term_frequencies(documents(spark, folder))), path)
    return read_zipf_csv(spark, path, 1000)


def qrels_file(spark, folder):
    """Judgements by url, written as nested JSON and read again."""
    path = work_path(spark, "qrels")
    log = table(spark, folder, "search_queries")
    write_qrels_json(evaluate.clean_qrels(table(spark, folder, "qrels"), "url").join(log, "qid"), path)
    nested = spark.read.schema("id INT, query STRING, relevant_urls MAP<STRING,INT>").json(path)
    return nested.select(F.col("id").alias("qid"), "query", F.explode("relevant_urls").alias("key", "grade"))


QUERIES = {
    f.__name__: f
    for f in (
        index_totals, index_saved, search_many_terms, jsonl_documents, export_metadata, document_table, zipf_file, qrels_file, grade_pool, metrics_domain,
        tokenize_docs, token_positions, term_frequency, stem_vocabulary, postings, doc_frequency, idf_table, docs_table, collection_frequency,
        zipf_top, corpus_stats, ranked_search, ranked_search_batch, match_counts, result_pool, grade_docs, grade_histogram, metrics_per_query,
        metrics_avg, mean_ap, qrels_urls, qrels_coverage, qrels_coverage_summary,
    )
} | {name: _boolean(query) for name, query in BOOLEAN.items()}

# ---------------------------------------------------------------------------------------------- SQL

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_TOKENS = f"""
ix AS (SELECT doc_id, coalesce(url, '') AS url, coalesce(title, '') AS title, text FROM documents WHERE strlen(text) >= 50),
raw AS (SELECT doc_id, list_filter(regexp_extract_all({_LOWER}, '[a-z][a-z'']*'), lambda t: length(t) >= 2) AS r FROM ix),
tk AS (SELECT doc_id, list_filter(r, lambda t: t NOT IN ({_STOP})) AS t FROM raw),
tok AS (SELECT doc_id, unnest(t) AS token FROM tk),
voc AS (SELECT DISTINCT token FROM tok),
st AS ({stem_sql("voc", "duckdb")}),
post AS (SELECT st.stem AS term, doc_id, count(*)::INT AS tf FROM tok JOIN st USING (token) GROUP BY ALL),
docs AS (SELECT ix.doc_id, url, title, len(t)::INT AS doc_len FROM ix JOIN tk USING (doc_id)),
vocab AS (SELECT term, count(*)::INT AS df FROM post GROUP BY term),
n AS (SELECT max(doc_id) + 1 AS n FROM docs),
freq AS (SELECT term, sum(tf)::BIGINT AS frequency FROM post GROUP BY term)"""
_WITH = f"WITH {_TOKENS}\n"


def _sql_set(node) -> str:
    if isinstance(node, Leaf):
        return f"SELECT doc_id FROM post WHERE term = '{node.term}'"
    if isinstance(node, Everything):
        return "SELECT doc_id FROM docs WHERE url <> ''"
    word = {And: "INTERSECT", Or: "UNION", Minus: "EXCEPT"}[type(node)]
    return f"(SELECT doc_id FROM ({_sql_set(node.left)}) AS l {word} SELECT doc_id FROM ({_sql_set(node.right)}) AS r)"


def _sql_scores(qid: int, query: str) -> str:
    terms = ", ".join(f"'{t}'" for t in query_terms(query))
    low = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    return f"""SELECT {qid}::INT AS qid, m.doc_id, any_value(docs.url) AS url, any_value(docs.title) AS title,
  round(coalesce(sum((1 + ln(p.tf)) * (ln((n.n + 1.0) / (v.df + 1.0)) + 1)
    + CASE WHEN contains(translate(docs.title, {low}), p.term) THEN 0.35 ELSE 0 END
    + CASE WHEN contains(translate(docs.url, {low}), p.term) THEN 0.15 ELSE 0 END), 0)
    / CASE WHEN any_value(docs.doc_len) > 0 THEN sqrt(any_value(docs.doc_len)) ELSE 1 END, 6) AS score
FROM (SELECT doc_id FROM ({_sql_set(tree(query))}) AS x) AS m JOIN docs USING (doc_id) CROSS JOIN n
LEFT JOIN post p ON p.doc_id = m.doc_id AND p.term IN ({terms}) LEFT JOIN vocab v ON v.term = p.term
GROUP BY m.doc_id"""


#: The logged queries of the test collection (a table of fixed content), for the SQL of batches.
LOG = {
    1: "reactor AND shelter", 2: "rifle OR helmet", 3: "quest AND courier", 4: "radiation", 5: "settler AND raider", 6: "tunnel OR quarry",
    7: "turret NOT drone", 8: "convoy", 9: "crafting AND workbench", 10: "foundry OR kiln", 11: "relay NOT antenna", 12: "medkit",
    13: "archive AND ledger", 14: "dam OR turbine", 15: "caravan", 16: "vault AND keycard", 17: "mutant NOT patrol", 18: "greenhouse",
    19: "copper AND coil", 20: "observatory",
}

_SCORED = "scored AS (" + "\nUNION ALL ".join(_sql_scores(q, t) for q, t in LOG.items()) + ")"
_BATCH = f"""{_WITH}, {_SCORED},
run AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank, doc_id, url, score FROM scored) WHERE rank <= 100)"""


def _sql_grade(query: str) -> str:
    wanted, unwanted, kind = evaluate.parse_judged_query(query)
    title, text = "lower(coalesce(title, ''))", "lower(coalesce(text, ''))"
    counts = [f"((length({text}) - length(replace({text}, '{w}', ''))) // {len(w)})" for w in wanted]
    titled = [f"contains({title}, '{w}')" for w in wanted]
    t = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in titled)
    least, most = f"least({', '.join(counts)})", f"greatest({', '.join(counts)})"
    if kind == "AND":
        level = f"CASE WHEN ({t}) = {len(wanted)} AND {least} >= 3 THEN 3 WHEN ({t}) > 0 AND {least} >= 2 THEN 2 WHEN {least} >= 2 THEN 1 ELSE 0 END"
    elif kind == "OR":
        best = f"greatest({', '.join(f'CASE WHEN {x} THEN {c} ELSE 0 END' for x, c in zip(titled, counts, strict=True))})"
        present = " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in counts)
        level = (
            f"CASE WHEN ({t}) >= 2 OR (({t}) >= 1 AND {best} >= 5) THEN 3 WHEN ({t}) >= 1 AND {best} >= 2 THEN 2"
            f" WHEN ({present}) >= 2 AND {most} >= 5 THEN 2 WHEN ({present}) >= 2 AND {most} >= 3 THEN 1 WHEN {most} >= 5 THEN 1 ELSE 0 END"
        )
    else:
        level = f"CASE WHEN {titled[0]} AND {counts[0]} >= 10 THEN 3 WHEN {titled[0]} AND {counts[0]} >= 3 THEN 2 WHEN {counts[0]} >= 15 THEN 2 WHEN {counts[0]} >= 5 THEN 1 ELSE 0 END"
    bad = " OR ".join(f"contains({title}, '{w}')" for w in unwanted)
    return f"CASE WHEN {bad} THEN 0 ELSE {level} END" if bad else level


_GRADES = "g AS (" + " UNION ALL ".join(f"SELECT {q}::INT AS qid, doc_id, ({_sql_grade(t)})::INT AS grade FROM documents" for q, t in LOG.items()) + "), graded AS (SELECT * FROM g WHERE grade > 0)"
_JUDGED = "j AS (SELECT qid, doc_id AS key, max(grade) AS grade FROM qrels WHERE qid IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL GROUP BY ALL)"
_METRIC_ROWS = f"""{_BATCH}, {_JUDGED},
seen AS (SELECT r.qid, r.rank, j.grade, coalesce(j.grade, 0) AS level FROM run r LEFT JOIN j ON j.qid = r.qid AND j.key = r.doc_id WHERE r.rank <= 20),
rows_ AS (SELECT *, (2.0 ** level - 1) / log2(rank + 1) AS gain, (2.0 ** level - 1) / 8.0 AS stop FROM seen),
reach AS (SELECT *, coalesce(product(1 - stop) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS reach FROM rows_),
ranked AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, key) AS rank FROM j),
ideal AS (SELECT qid, {", ".join(f"sum(CASE WHEN rank <= {k} THEN (2.0 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS i{k}" for k in (5, 10, 20))} FROM ranked GROUP BY qid),
sums AS (SELECT qid, {", ".join(f"sum(CASE WHEN rank <= {k} AND grade IS NOT NULL THEN 1 ELSE 0 END) AS h{k}, sum(CASE WHEN rank <= {k} THEN gain ELSE 0 END) AS d{k}, sum(CASE WHEN rank <= {k} THEN reach * stop / rank ELSE 0 END) AS e{k}" for k in (5, 10, 20))} FROM reach GROUP BY qid),
per AS (SELECT s.qid, {", ".join(f"round(h{k} / {k}.0, 6) AS p_{k}, round(d{k}, 6) AS dcg_{k}, round(CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0 END, 6) AS ndcg_{k}, round(e{k}, 6) AS err_{k}" for k in (5, 10, 20))} FROM sums s LEFT JOIN ideal USING (qid))"""
_METRIC_NAMES = [f"{m}_{k}" for k in (5, 10, 20) for m in ("p", "dcg", "ndcg", "err")]
_COVER = f"""{_WITH}, ju AS (SELECT qid, url AS key, max(grade) AS grade FROM qrels WHERE qid IS NOT NULL AND url IS NOT NULL AND grade IS NOT NULL GROUP BY ALL),
cov AS (SELECT qid, count(*) AS relevant, count(d.url) AS covered, round(count(d.url) / count(*), 6) AS coverage FROM ju LEFT JOIN (SELECT DISTINCT url FROM docs) d ON d.url = ju.key GROUP BY qid)"""

_LINE = "strlen(text) >= 50"


def _domain_sql() -> str:
    host = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    rows = _METRIC_ROWS.replace("FROM run r LEFT JOIN j", "FROM own r LEFT JOIN j").replace("j.key = r.doc_id", "j.key = r.url")
    own = f"own AS (SELECT qid, url, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM run WHERE url <> '' AND {host.format('url')} = '{DOMAIN}')"
    judged = f"j AS (SELECT qid, url AS key, max(grade) AS grade FROM qrels WHERE qid IS NOT NULL AND url IS NOT NULL AND grade IS NOT NULL AND {host.format('url')} = '{DOMAIN}' GROUP BY ALL)"
    return rows.replace(_JUDGED, f"{judged}, {own}")


SQL = {
    "index_totals": f"{_WITH}SELECT (SELECT max(doc_id) + 1 FROM docs) AS size, (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM vocab) AS vocabulary",
    "search_many_terms": f"{_WITH}, s AS ({_sql_scores(1, MANY_TERMS)} UNION ALL {_sql_scores(2, RANKED)}) SELECT qid, doc_id, score FROM s",
    "jsonl_documents": f"SELECT doc_id, url, title, md5(text) AS text_md5 FROM documents WHERE {_LINE}",
    "export_metadata": "SELECT doc_id, url, title, source, source_domain, timestamp, length(text)::INT AS text_length FROM documents",
    "document_table": f"{_WITH}SELECT doc_id, nullif(url, '') AS url, nullif(title, '') AS title FROM docs",
    "zipf_file": _WITH + "SELECT * FROM (SELECT row_number() OVER (ORDER BY frequency DESC, term)::INT AS rank, frequency, term FROM freq) WHERE rank <= 1000",
    "qrels_file": "SELECT qid, query, url AS key, max(grade) AS grade FROM qrels JOIN search_queries USING (qid) WHERE url IS NOT NULL AND grade IS NOT NULL GROUP BY ALL",
    "grade_pool": f"{_BATCH}, {_GRADES} SELECT g.qid, g.doc_id, g.grade FROM graded g JOIN run USING (qid, doc_id)",
    "metrics_domain": _domain_sql() + f" SELECT qid, {', '.join(_METRIC_NAMES)} FROM per",
    "tokenize_docs": _WITH + "SELECT doc_id, len(t)::INT AS doc_len, md5(array_to_string(t, ' ')) AS tokens_md5 FROM tk",
    "token_positions": _WITH + "SELECT doc_id, unnest(range(len(r)))::INT AS pos, unnest(r) AS token FROM raw",
    "term_frequency": _WITH + "SELECT doc_id, token, count(*)::INT AS n FROM tok GROUP BY ALL",
    "stem_vocabulary": _WITH + "SELECT token, stem FROM st",
    "postings": _WITH + "SELECT term, doc_id, tf FROM post",
    "doc_frequency": _WITH + "SELECT term, df FROM vocab",
    "idf_table": _WITH + "SELECT term, round(ln((n.n + 1.0) / (df + 1)) + 1, 6) AS idf FROM vocab, n",
    "docs_table": _WITH + "SELECT doc_id, url, title, doc_len FROM docs",
    "collection_frequency": _WITH + "SELECT term, frequency FROM freq",
    "zipf_top": _WITH
    + "SELECT rank, frequency, term, round(first_value(frequency) OVER (ORDER BY rank) / rank, 6) AS theory FROM (SELECT row_number() OVER (ORDER BY frequency DESC, term)::INT AS rank, frequency, term FROM freq) WHERE rank <= 10000",
    "corpus_stats": _WITH
    + """, b AS (SELECT (SELECT count(*) FROM ix) AS documents, (SELECT count(*) FROM tok) AS tokens, (SELECT sum(length(token))::BIGINT FROM tok) AS token_chars,
      (SELECT sum(length(term) * frequency)::BIGINT FROM freq) AS stem_chars, (SELECT sum(strlen(text))::BIGINT FROM ix) AS text_bytes, (SELECT count(*) FROM freq) AS vocabulary)
    SELECT *, round(tokens / documents, 6) AS tokens_per_document, round(token_chars / tokens, 6) AS mean_token_length, round(stem_chars / tokens, 6) AS mean_stem_length,
      round(100 * (token_chars - stem_chars) / token_chars, 6) AS reduction_percent FROM b""",
    "ranked_search": f"{_WITH}, s AS ({_sql_scores(0, RANKED)}) SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, url, title, score FROM s) WHERE rank <= 100",
    "ranked_search_batch": _BATCH + " SELECT qid, rank, doc_id, score FROM run",
    "match_counts": f"{_WITH}, {_SCORED} SELECT qid, count(*) AS matches FROM scored GROUP BY qid",
    "result_pool": _BATCH + " SELECT DISTINCT doc_id FROM run",
    "grade_docs": f"WITH {_GRADES} SELECT qid, doc_id, grade FROM graded",
    "grade_histogram": f"WITH {_GRADES} SELECT qid, grade, count(*) AS n FROM graded GROUP BY ALL",
    "metrics_per_query": _METRIC_ROWS + f" SELECT qid, {', '.join(_METRIC_NAMES)} FROM per",
    "metrics_avg": _METRIC_ROWS + " SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _METRIC_NAMES) + " FROM per",
    "mean_ap": f"""{_BATCH}, {_JUDGED},
seen AS (SELECT r.qid, r.rank, CASE WHEN j.grade IS NULL THEN 0 ELSE 1 END AS hit FROM run r LEFT JOIN j ON j.qid = r.qid AND j.key = r.doc_id),
prec AS (SELECT qid, hit, sum(hit) OVER (PARTITION BY qid ORDER BY rank) / rank AS p FROM seen),
ap AS (SELECT qid, round(sum(p * hit) / any_value(t.n), 6) AS ap FROM prec JOIN (SELECT qid, count(*) AS n FROM j GROUP BY qid) t USING (qid) GROUP BY qid)
SELECT round(avg(ap), 6) AS map FROM ap""",
    "qrels_urls": f"{_WITH}, {_JUDGED} SELECT j.qid, docs.url AS key, max(j.grade) AS grade FROM j JOIN docs ON docs.doc_id = j.key WHERE docs.url <> '' GROUP BY ALL",
    "qrels_coverage": _COVER + " SELECT qid, relevant, covered, coverage FROM cov",
    "qrels_coverage_summary": _COVER + " SELECT round(avg(coverage), 6) AS macro_coverage, round(sum(covered) / sum(relevant), 6) AS micro_coverage, avg(coverage) < 0.5 AS low FROM cov",
} | {name: f"{_WITH}SELECT doc_id FROM ({_sql_set(tree(query))}) AS x" for name, query in BOOLEAN.items()}

SQL["index_saved"] = SQL["ranked_search"]

assert not any(holds_without_terms(tree(q)) for q in LOG.values())
