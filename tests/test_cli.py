import json

from loresift import __main__ as cli
from loresift.functions.register import register

PAD = " with enough other words to pass the limit of fifty bytes"


def test_build_search_evaluate(spark, tmp_path):
    docs = [
        {"doc_id": 0, "url": "https://a.x/0", "title": "Reactor", "text": "reactors in a shelter" + PAD},
        {"doc_id": 1, "url": "https://b.x/1", "title": "Drone", "text": "drones near a reactor" + PAD},
        {"doc_id": 2, "url": "https://a.x/2", "title": "No", "text": "too short"},
    ]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\nbroken line that is long enough to be looked at, but no json\n")
    cli.build(spark, f"{tmp_path}/d.jsonl", f"{tmp_path}/index", f"{tmp_path}/ranks")
    assert cli.find(spark, f"{tmp_path}/index", "reactor NOT drone") == ["Found 1 documents", "0\thttps://a.x/0\tReactor"]
    assert cli.find(spark, f"{tmp_path}/index", "zzz") == ["Found 0 documents"]
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": 1, "query": "reactor", "relevant_urls": {"https://a.x/0": 3}}], "relevance_levels": {}}))
    assert cli.score(spark, f"{tmp_path}/index", f"{tmp_path}/q.json")["ndcg_5"] == 1.0
    assert cli.score(spark, f"{tmp_path}/index", f"{tmp_path}/q.json", "a.x")["p_5"] == 0.2


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT stem('ponies') AS s, tokenize('The Vaults') AS t").first()
    assert row.s == "poni" and row.t == ["vaults"]
