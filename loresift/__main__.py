"""Command line: ``python -m loresift build docs.jsonl index``, ``search``, ``evaluate``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .operators import evaluate, search
from .operators.index import Index, build_index, term_frequencies, zipf
from .session import ship
from .sources import read_documents_jsonl, read_qrels_json, write_zipf_csv


def build(spark: SparkSession, source: str, index: str, ranks: str | None = None) -> None:
    """Index a JSON lines export; optionally write the rank list of its terms."""
    documents = read_documents_jsonl(spark, source)
    build_index(documents).save(index)
    if ranks:
        write_zipf_csv(zipf(term_frequencies(documents)), ranks)


def find(spark: SparkSession, index: str, query: str) -> list[str]:
    """A line with the number of matches, then one per result: id, url, title."""
    loaded = Index.load(spark, index)
    total = search.count_matches(loaded, query).first().matches
    rows = search.search(loaded, query).orderBy("rank").collect()  # at most a hundred
    return [f"Found {total} documents", *(f"{r.doc_id}\t{r.url}\t{r.title}" for r in rows)]


def score(spark: SparkSession, index: str, qrels: str, source_domain: str | None = None) -> dict[str, float]:
    """Mean metrics of the judged queries against an index, by url; optionally of one domain."""
    loaded = Index.load(spark, index)
    judged = read_qrels_json(spark, qrels)
    queries = {r.qid: r.query for r in judged.select("qid", "query").distinct().collect()}  # the judged queries
    run = search.search_many(loaded, queries).where("url <> ''")
    wanted = evaluate.clean_qrels(judged, "key")
    if source_domain:
        ranked, wanted = evaluate.of_domain(run, wanted, source_domain)
    else:
        order = Window.partitionBy("qid").orderBy("rank")
        ranked = run.select("qid", F.row_number().over(order).alias("rank"), F.col("url").alias("key"))
    row = evaluate.mean_metrics(evaluate.metrics(ranked, wanted)).first()
    return row.asDict()


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="loresift", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("build")
    one.add_argument("source")
    one.add_argument("index")
    one.add_argument("ranks", nargs="?")
    two = commands.add_parser("search")
    two.add_argument("index")
    two.add_argument("query")
    three = commands.add_parser("evaluate")
    three.add_argument("index")
    three.add_argument("qrels")
    three.add_argument("--source-domain")
    options = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loresift").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if options.command == "build":
        build(spark, options.source, options.index, options.ranks)
    elif options.command == "search":
        print("\n".join(find(spark, options.index, options.query)))
    else:
        print("\n".join(f"{k}: {v:.4f}" for k, v in score(spark, options.index, options.qrels, options.source_domain).items()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
