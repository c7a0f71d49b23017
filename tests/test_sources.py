import json
import os
import signal

import pytest

from loresift.config import Config, load_config
from loresift.operators.store import StateStore, resume_points
from loresift.sources import open_source, read_all_categories, read_category_members
from loresift.sources.wiki import response_name
from loresift.streaming.ingest import stop_on_signal


def answer(kind, items, token=None, field="cmcontinue"):
    return json.dumps({"query": {kind: items}, **({"continue": {field: token}} if token else {})})


def test_paged_wiki(spark, tmp_path):
    """Continuations are followed in order; loops, missing and broken answers end a listing."""
    one, two, three = (tmp_path / n for n in ("One", "Two", "Three"))
    for folder in (one, two, three):
        folder.mkdir()
    member = lambda title, ns=0: {"ns": ns, "title": title}
    (one / response_name(None)).write_text(answer("categorymembers", [member("A b"), member("Talk:A", 1), member("")], "page|2"))
    (one / response_name("page|2")).write_text(answer("categorymembers", [member("C"), member("A b")], "page|3"))
    (one / response_name("page|3")).write_text(answer("categorymembers", [member("D")], "page|2"))
    (two / response_name(None)).write_text(answer("categorymembers", [member("E"), {"ns": 0, "title": None}], "lost"))
    (three / response_name(None)).write_text("{broken")
    got = {(r.listing, r.url) for r in read_category_members(spark, str(tmp_path), "w.x").collect()}
    assert got == {("One", "https://w.x/wiki/A_b"), ("One", "https://w.x/wiki/C"), ("One", "https://w.x/wiki/D"), ("Two", "https://w.x/wiki/E")}
    assert read_category_members(spark, str(tmp_path), "w.x", ["other.x"]).count() == 0


def test_paged_categories(spark, tmp_path):
    folder = tmp_path / "all"
    folder.mkdir()
    (folder / response_name(None)).write_text(answer("allcategories", [{"*": "Guns"}, {"category": "Category:Maps"}, {"*": " "}], "x", "accontinue"))
    (folder / response_name("x")).write_text(answer("allcategories", [{"*": "Guns"}, {"name": "Old Keys"}]))
    got = {r.url for r in read_all_categories(spark, str(tmp_path), "w.x").collect()}
    assert got == {f"https://w.x/wiki/Category{c}" for c in ("%3AGuns", "%3AMaps", "%3AOld_Keys")}


STATE = "_id string, current_category_index int, current_category_url string, current_article_index int, categories array<string>, last_updated long"


def test_states(spark, tmp_path):
    states = StateStore(spark, f"file://{tmp_path}/states")
    assert states.read() is None and states.get("a") is None
    rows = lambda *r: spark.createDataFrame(list(r), STATE)
    states.save(rows(("a", 0, "c0", 3, ["c0", "c1"], 1), ("site", None, None, None, None, None)))
    states.save(rows(("a", 1, "c1", 0, ["c0", "c1"], 2), ("b", 2, None, 0, ["c0", "c1"], 2)))
    assert states.get("a")["current_category_url"] == "c1" and states.get("none") is None
    points = {r._id: (r.category_index, r.article_index, r.category_url, r.finished) for r in resume_points(states.read()).collect()}
    assert points == {"a": (1, 0, "c1", False), "b": (2, 0, None, True), "site": (0, 0, None, False)}
    states.clear("a")
    assert states.get("a") is None and states.read().count() == 2


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"crawler_id": "a", "domain_whitelist": ["x.y"], "max_depth": 2}')
    assert load_config(f"{tmp_path}/c.json") == Config("a", domain_whitelist=["x.y"], max_depth=2)
    (tmp_path / "bad.json").write_text('{"depth": 2}')
    with pytest.raises(ValueError, match="depth"):
        load_config(f"{tmp_path}/bad.json")
    with pytest.raises(OSError):
        load_config(f"{tmp_path}/none.json")


def test_named_sources(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert open_source(spark, "parquet", f"{tmp_path}/t").count() == 3
    with pytest.raises(ValueError, match="jsonl"):
        open_source(spark, "nothing", "x")


def test_stop_on_signal():
    class Query:
        stopped = 0

        def stop(self):
            self.stopped += 1

    query, before = Query(), signal.getsignal(signal.SIGTERM)
    try:
        stop_on_signal(query, [signal.SIGTERM])
        os.kill(os.getpid(), signal.SIGTERM)
        assert query.stopped == 1
    finally:
        signal.signal(signal.SIGTERM, before)
