import json

import pytest
from pyspark.sql import functions as F

from loresift.functions import html, urls
from loresift.operators import curate, links, store
from loresift.operators.incremental import Commit, CommitLog, IncrementalJob, changed_pages, export_changes, with_file_times
from loresift.sources import (
    read_document_table,
    read_documents_jsonl,
    read_mediawiki_categories,
    read_mediawiki_members,
    read_qrels_json,
    read_zipf_csv,
    write_document_table,
    write_documents_jsonl,
    write_qrels_json,
    write_zipf_csv,
)
from loresift.streaming.ingest import ingest

PAGE = "_id string, url string, html string, source string, source_domain string, timestamp long, content_hash string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("url", "export", "crawl"),
    [
        ("HTTPS://M.Ex.com//a//b/?q=1#t", "https://m.ex.com/a/b", "https://m.ex.com//a//b?q=1"),
        ("http://x.com", "http://x.com/", "http://x.com"),
        ("http://X.com/a/?b=2&a=1&b=1#f", "http://x.com/a", "http://x.com/a?a=1&b=2&b=1"),
        ("http://x.com/a?a", "http://x.com/a", "http://x.com/a?a="),
        ("http://x.com/a;p=1", "http://x.com/a", "http://x.com/a;p=1"),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_normal_urls(spark, url, export, crawl):
    value = F.lit(url).cast("string")
    assert one(spark, urls.normalize_export(value)) == export
    assert one(spark, urls.normalize_crawl(value)) == crawl


def test_url_filters(spark):
    check = lambda f, u, *a: one(spark, f(F.lit(u).cast("string"), *a))
    assert check(urls.is_noise, None) and check(urls.is_noise, "http://x/a.PNG") and check(urls.is_noise, "http://x/static/a") and not check(urls.is_noise, "http://x/a")
    assert check(urls.is_valid, "http://www.a.b/x", ["a.b"]) and check(urls.is_valid, "https://c.a.b/", ["www.a.b"]) and not check(urls.is_valid, "https://xa.b/", ["a.b"])
    assert not check(urls.is_valid, "ftp://a.b/") and not check(urls.is_valid, "/x") and not check(urls.is_valid, None)
    assert not check(urls.is_content, "http://a.b/Login") and check(urls.is_content, "http://a.b/wiki/X")
    assert one(spark, urls.title_to_url(F.lit("A b's/ü*"), "w.x")) == "https://w.x/wiki/A_b%27s%2F%C3%BC%2A"
    assert one(spark, urls.url_to_title(F.lit("https://w.x/wiki/A_b%27s%2F%C3%BC"))) == "A b's/ü"
    assert one(spark, urls.category_name(F.create_map(F.lit("*"), F.lit(" "), F.lit("title"), F.lit(" T ")))) == "T"


def test_clean_html():
    page = "<html><head><title> T &amp; t </title><script>x</script></head><body><nav>menu</nav><div class='a page-footer'>foot</div><div id='my-cookie-box'>c</div><p>One<b>two</b></p><!-- no --><p>three</body>"
    assert html.clean(page) == ("T & t", "T & t One two three")
    assert html.clean("<h1>Head</h1><p>x") == ("Head", "Head x")
    assert html.clean(None) == html.clean("") == ("", "")


def test_challenges(spark):
    assert one(spark, html.has_captcha(F.lit("hCaptcha"), F.lit(403))) and not one(spark, html.has_captcha(F.lit("hcaptcha"), F.lit(200)))
    assert one(spark, html.has_captcha(F.lit("hcaptcha cf-ray"), F.lit(200))) and not one(spark, html.has_captcha(F.lit(None).cast("string"), F.lit(403)))
    assert one(spark, html.is_challenge(F.lit("Just a moment..."))) and not one(spark, html.is_challenge(F.lit(None).cast("string")))


def page(words):
    return f"<html><title>Title</title><body><p>{words}</p></body></html>"


def test_curation(spark):
    good = page(" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)))
    rows = [
        ("1", "http://x/a", page("short"), None, None, 1, None), ("2", "http://x/a/", good, None, None, None, None), ("3", "http://x/a//", good, "s", "d", 3, None),
        ("4", "http://x/b.png", good, "s", "d", 4, None), ("5", "http://x/c", None, "s", "d", 5, None), ("6", "http://x/d", good, "s", "d", 6, None),
        ("6", "http://x/d", good, "s", "d", 6, None), ("7", None, good, "s", "d", 7, None),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGE + ", norm_url string")
    reasons = {r._id: r.reason for r in curate.with_reasons(curate.cleaned(pages)).collect()}
    assert reasons == {"1": "low_quality", "2": "exported", "3": "duplicate", "4": "noise", "5": "low_quality", "6": "exported", "7": "noise"}
    kept = curate.curate(pages).orderBy("doc_id").collect()
    assert [(r.doc_id, r.url, r.source, r.timestamp) for r in kept] == [(0, "http://x/a", "Unknown", 0), (1, "http://x/d", "s", 6)]
    assert curate.curate(pages.limit(0)).count() == 0
    numbered = curate.dense_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), ["v"]).collect()
    assert all(r.doc_id == r.v for r in numbered)


def writes(spark, rows):
    return spark.createDataFrame([(i, u, h, None, d, t, "WRONG") for i, u, h, d, t in rows], PAGE)


def test_changed_pages(spark):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    log = writes(spark, [
        ("1", "a", "old", "d", 5), ("2", "a", "new", "d", 5), ("3", "b", "same", "d", None), ("4", "b", "older", "d", None), ("5", "c", None, "d", 9),
        ("6", "e", "x", None, 1), ("6", "e", "x", None, 1), ("7", "f", "f1", "d", 1), ("8", "f", "f0", "d", None),
    ])
    runs = spark.createDataFrame([(1, "success", 0, 1), (2, "success", 1, 2), (3, "failed", 2, None)], "run_id int, status string, started long, finished long")
    entries = spark.createDataFrame(
        [(1, "a", "d", 1, md5("new")), (2, "a", "d", 1, md5("old")), (1, "b", "d", 1, md5("older")), (3, "f", "d", 1, md5("f1")), (1, "f", "d", 1, md5("f1")), (1, "f", "d", 1, md5("f1"))],
        "run_id int, url string, source_domain string, timestamp long, content_hash string",
    )
    got = {(r.url, r.source_domain) for r in changed_pages(log, runs, entries).collect()}
    assert got == {("a", "d"), ("e", None)}
    assert changed_pages(log.limit(0), runs, entries).count() == 0
    assert changed_pages(log, runs.limit(0), entries).count() == 4


def test_incremental_job_survives_failures(spark, tmp_path):
    root = f"file://{tmp_path}/job"
    rows = lambda *n: spark.createDataFrame([(k, f"r{k}") for k in n], "sequence long, v string")
    job = IncrementalJob(spark, root)
    assert job.run(rows(1, 2, 3), lambda d: d).watermark == 3

    def broken(d):
        d.write.parquet(f"{root}/data/orphan")  # output without a commit
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        job.run(rows(1, 2, 3, 4), broken)
    assert {r.v for r in job.read().collect()} == {"r1", "r2", "r3"}
    assert job.run(rows(1, 2, 3, 4, 5), lambda d: d).watermark == 5
    assert sorted(r.sequence for r in job.read().collect()) == [1, 2, 3, 4, 5]
    assert job.run(rows(1, 5), lambda d: d) is None
    with pytest.raises(ValueError, match="sequence"):
        job.run(spark.createDataFrame([(None, "x")], "sequence long, v string"), lambda d: d)
    log = CommitLog(spark, root)
    assert not log.publish(log.commits()[0])  # a number is committed once


def test_export_changes_publishes_once(spark, tmp_path):
    log = writes(spark, [("1", "a", "x", "d", 1)])
    runs = spark.createDataFrame([(4, "success", 0, 1), (7, "failed", 0, None)], "run_id int, status string, started long, finished long")
    entries = spark.createDataFrame([], "run_id int, url string, source_domain string, timestamp long, content_hash string")
    root = f"file://{tmp_path}/export"
    assert export_changes(spark, root, log, runs, entries).count() == 1
    commit = CommitLog(spark, root).commits()[0]
    assert (commit.number, commit.watermark) == (8, 7)


def test_export_changes_exactly_once(spark, tmp_path, monkeypatch):
    runs = spark.createDataFrame([(4, "success", 0, 1)], "run_id int, status string, started long, finished long")
    entries = spark.createDataFrame([(4, "b", "d", 1, "0" * 32)], "run_id int, url string, source_domain string, timestamp long, content_hash string")
    rows = [("1", "a", "x", "d", 5), ("2", "b", "y", "d", 5), ("3", "e", "z", None, None)]
    sequenced = lambda *parts: writes(spark, [r for p in parts for r in p]).withColumn("sequence", F.col("_id").cast("long"))
    root = f"file://{tmp_path}/export"
    run = lambda log, **options: {(r.url, r.source_domain) for r in export_changes(spark, root, log, runs, entries, **options).collect()}
    assert run(sequenced(rows)) == {("a", "d"), ("b", "d"), ("e", None)}
    assert run(sequenced(rows)) == set()
    # a late write of a, a new one of b, a page of its own, and one that repeats what was delivered
    more = [("4", "a", "late", "d", 4), ("5", "b", "y2", "d", 6), ("6", "g", "g", "d", 1), ("7", "e", "z", None, 9)]
    with monkeypatch.context() as broken:
        broken.setattr(CommitLog, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run(sequenced(rows, more))
    assert run(sequenced(rows, more)) == {("b", "d"), ("g", "d")}  # the run that died is done again
    assert run(sequenced(rows, more), overlap=100) == set()
    assert run(sequenced(rows, more).drop("sequence")) == set()
    assert run(sequenced(rows, more).limit(0)) == set()
    # a successful run of the record delivered g meanwhile, in another version
    later = spark.createDataFrame([(99, "success", 0, 1)], runs.schema)
    other = spark.createDataFrame([(99, "g", "d", 1, "1" * 32)], entries.schema)
    assert [(r.url, r.source_domain) for r in export_changes(spark, root, sequenced(rows, more), runs.union(later), entries.union(other)).collect()] == [("g", "d")]


def test_two_publishers(spark, tmp_path, monkeypatch):
    """Of two runs that fix the same number, one delivers and one raises."""
    root = f"file://{tmp_path}/export"
    log = CommitLog(spark, root)
    commit = Commit(3, 7, "somewhere")
    assert [log.publish(commit), log.publish(commit)] == [True, False]
    assert [f.name for f in (tmp_path / "export" / "_commits").iterdir() if f.suffix == ".json"] == ["000000003.json"]
    hidden = CommitLog.commits
    monkeypatch.setattr(CommitLog, "commits", lambda self: hidden(self)[:-1])  # as seen before the other one committed
    runs = spark.createDataFrame([(2, "success", 0, 1)], "run_id int, status string, started long, finished long")
    entries = spark.createDataFrame([], "run_id int, url string, source_domain string, timestamp long, content_hash string")
    with pytest.raises(RuntimeError):
        export_changes(spark, root, writes(spark, [("1", "a", "x", "d", 5)]), runs, entries)


def test_publish_by_rename(spark, tmp_path, monkeypatch):
    """On file systems other than a local disk."""
    log = CommitLog(spark, f"file://{tmp_path}/log")

    class Other:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def getScheme(self):
            return "other"

    monkeypatch.setattr(log, "_fs", Other(log._fs))
    assert [log.publish(Commit(1, 5, "a")), log.publish(Commit(1, 6, "b"))] == [True, False]
    assert [c.output for c in log.commits()] == ["a"]


def test_publish_without_links(spark, tmp_path, monkeypatch):
    import os

    def refuse(*_):
        raise PermissionError("no links here")

    monkeypatch.setattr(os, "link", refuse)
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert [log.publish(Commit(1, 5, "a")), log.publish(Commit(1, 6, "b")), log.publish(Commit(2, 6, "c"))] == [True, False, True]
    assert [c.output for c in log.commits()] == ["a", "c"]


def test_file_times_bound_a_run(spark, tmp_path):
    """A log of parquet files: files that come later belong to the next run, which reads no others."""
    import os

    root, folder = f"file://{tmp_path}/export", tmp_path / "log"
    runs = spark.createDataFrame([], "run_id int, status string, started long, finished long")
    entries = spark.createDataFrame([], "run_id int, url string, source_domain string, timestamp long, content_hash string")

    def add(name, rows, when):
        writes(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/new")
        (part,) = (tmp_path / "new").glob("*.parquet")
        folder.mkdir(exist_ok=True)
        part.rename(folder / f"{name}.parquet")
        os.utime(folder / f"{name}.parquet", (when, when))
        __import__("shutil").rmtree(tmp_path / "new")

    def run():
        return sorted(r.url for r in export_changes(spark, root, with_file_times(spark.read.parquet(str(folder))), runs, entries).collect())

    add("one", [("1", "a", "x", "d", 1), ("2", "b", "y", "d", 1)], 1000)
    assert run() == ["a", "b"] and run() == []
    add("two", [("3", "b", "y2", "d", 2), ("4", "c", "z", "d", 1), ("5", "a", "late", "d", None)], 2000)
    (folder / "one.parquet").write_bytes(b"no parquet any more")  # must not be opened again
    os.utime(folder / "one.parquet", (1000, 1000))
    (folder / ".one.parquet.crc").unlink(missing_ok=True)
    read = spark.read.schema(PAGE).parquet(str(folder))
    assert sorted(r.url for r in export_changes(spark, root, with_file_times(read), runs, entries).collect()) == ["b", "c"]
    assert CommitLog(spark, root).commits()[-1].watermark == 2_000_000


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    pages = store.PageStore(spark, f"file://{tmp_path}/store", buckets=8)
    assert pages.upsert(writes(spark, [(str(k), f"u{k}", f"h{k}", "d", 1) for k in range(40)]))
    before = pages._folders()
    assert len(before) == 8 and pages.upsert(writes(spark, [("x", "u3", "new", "d", 2)]))
    after = pages._folders()
    assert sum(before[b] != after[b] for b in before) == 1
    assert [r.html for r in pages.lookup("u3", "d").collect()] == ["new"] and pages.lookup("u3", None).count() == 0
    state = {r.url: r.html for r in pages.read().collect()}
    assert state == {f"u{k}": f"h{k}" for k in range(40)} | {"u3": "new"}


def test_store_raises_when_another_writer_wins(spark, tmp_path, monkeypatch):
    pages = store.PageStore(spark, f"file://{tmp_path}/store")
    monkeypatch.setattr(CommitLog, "publish", lambda *_: False)
    with pytest.raises(RuntimeError):
        pages.upsert(writes(spark, [("1", "a", "x", "d", 1)]), 0)
    assert pages.read() is None


def test_store(spark, tmp_path):
    pages = store.PageStore(spark, f"file://{tmp_path}/store")
    assert pages.read() is None
    assert pages.upsert(writes(spark, [("1", "a", "x", "d", 1), ("2", "b", "y", "d", 1)]), 0)
    assert not pages.upsert(writes(spark, [("9", "z", "z", "d", 1)]), 0)  # the batch came before
    assert pages.upsert(writes(spark, [("3", "a", "x2", "d", 2), ("4", "b", "old", "d", None), ("5", "c", None, "d", 3)]), 1)
    state = {r.url: (r.html, r._id) for r in pages.read().collect()}
    assert state == {"a": ("x2", "3"), "b": ("y", "2")}
    stored = pages.read()
    fetched = spark.createDataFrame([("a", "d", "x2"), ("b", "d", "changed"), ("n", "d", "n")], "url string, source_domain string, html string")
    day = store.DAY
    need = lambda now: {r.url: r.reason for r in store.needs_update(stored, fetched, now).collect()}
    assert need(2 + 30 * day) == {"b": "changed", "n": "missing"}
    assert need(3 + 30 * day) == {"a": "stale", "b": "changed", "n": "missing"}
    assert store.lookup(stored, "a", "d").count() == 1 and store.lookup(stored, "a", "other").count() == 0 and store.lookup(stored, "a").count() == 1
    days = store.docs_per_day(writes(spark, [("1", "a", "", "d", 0), ("2", "a", "", "d", day - 1), ("3", "a", "", "d", day), ("4", "a", "", "d", None)]))
    assert {r.day: r.n for r in days.collect()} == {"1970-01-01": 2, "1970-01-02": 1}
    filled = store.backfill_domain(writes(spark, [("1", "a", "", None, 0)]), "x.y")
    assert filled.first().source_domain == "x.y" and store.backfill_domain(filled, "z").first().source_domain == "x.y"


def test_links(spark):
    body = """<a href="/wiki/B?b=2&amp;a=1#t">b</a><a class=x href='https://H.x/c/'>c</a><a href="#f">f</a><a href="javascript:x()">j</a><a href="">e</a>
      <a href="rel">r</a><a href="/login">l</a><a href="mailto:x@y">m</a><a href="/wiki/Category:Z">z</a>"""
    rows = spark.createDataFrame([("https://h.x/dir/page", body), ("https://h.x/null", None)], "url string, html string")
    got = {r.link for r in links.extract_links(rows).collect()}
    assert got == {"https://h.x/wiki/B?a=1&b=2", "https://h.x/c", "https://h.x/dir/rel", "https://h.x/wiki/Category:Z"}
    assert {r.link for r in links.category_links(rows).collect()} == {"https://h.x/wiki/Category:Z"}
    listing = '<a href="/wiki/Out">o</a><div class="category-page__members"><a href="/wiki/In">i</a><a href="/wiki/Special:X">s</a></div>'
    assert {r.link for r in links.article_links(spark.createDataFrame([("https://h.x/wiki/Category:Z", listing)], "url string, html string")).collect()} == {"https://h.x/wiki/In"}
    nxt = lambda h: one(spark, links.next_page(F.lit(h), F.lit("https://h.x/l")))
    assert nxt('<a class="mw-nextlink" href="/l?p=2">x</a>') == "https://h.x/l?p=2"
    assert nxt('<a href="/a">back</a><a href="/l3"><b>Next</b> 200</a>') == "https://h.x/l3"
    assert nxt('<a href="/a">next</a>') is None


def test_frontier(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "c"), ("x", "y")], "url string, link string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert {r.url: r.depth for r in links.frontier(edges, seeds, 5).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.url: r.depth for r in links.frontier(edges, seeds, 1).collect()} == {"a": 0, "b": 1, "c": 1}


def test_formats(spark, tmp_path):
    text = "long enough text " * 10
    docs = spark.createDataFrame([(0, "u", "t\t1", text), (1, "v", None, "short")], "doc_id long, url string, title string, text string")
    write_documents_jsonl(docs, f"{tmp_path}/d")
    assert [r.doc_id for r in read_documents_jsonl(spark, f"{tmp_path}/d").collect()] == [0]
    write_document_table(docs, f"{tmp_path}/t")
    assert sorted((r.doc_id, r.url) for r in read_document_table(spark, f"{tmp_path}/t").collect()) == [(0, "u"), (1, "v")]
    ranks = spark.createDataFrame([(1, 9, "a"), (2, 5, "b"), (20000, 1, "z")], "rank int, frequency long, term string")
    write_zipf_csv(ranks, f"{tmp_path}/z")
    assert sorted(r.rank for r in read_zipf_csv(spark, f"{tmp_path}/z").collect()) == [1, 2]
    assert read_zipf_csv(spark, f"{tmp_path}/z", 1).count() == 1
    nested = {"queries": [{"id": 1, "query": "q", "relevant_docs": {"5": 3}, "relevant_urls": {"u": 2}}, {"id": 2, "query": "r", "relevant_docs": {"6": 1}}], "relevance_levels": {"0": "no"}}
    (tmp_path / "q.json").write_text(json.dumps(nested))
    rows = lambda **k: sorted(map(tuple, read_qrels_json(spark, f"{tmp_path}/q.json", **k).collect()))
    assert rows() == [(1, "q", "u", 2)] and rows(strict=False) == [(1, "q", "u", 2), (2, "r", "6", 1)] and rows(by="docs") == [(1, "q", "5", 3), (2, "r", "6", 1)]
    write_qrels_json(read_qrels_json(spark, f"{tmp_path}/q.json"), f"{tmp_path}/out")
    (tmp_path / "c.json").write_text(json.dumps({"query": {"allcategories": [{"*": "A"}, {"category": "B"}, {"*": "A"}, {"*": " "}]}}))
    assert {r.category for r in read_mediawiki_categories(spark, f"{tmp_path}/c.json").collect()} == {"A", "B"}
    (tmp_path / "m.json").write_text(json.dumps({"query": {"categorymembers": [{"ns": 0, "title": "A b"}, {"ns": 14, "title": "C"}]}}))
    assert [r.url for r in read_mediawiki_members(spark, f"{tmp_path}/m.json", "w.x").collect()] == ["https://w.x/wiki/A_b"]


def test_stream_is_idempotent(spark, tmp_path):
    source = f"{tmp_path}/in"
    writes(spark, [("1", "a", "x", "d", 1), ("2", "b", "y", "d", 2)]).write.parquet(source)
    root = f"file://{tmp_path}/store"
    assert ingest(spark, source, root).count() == 2
    writes(spark, [("3", "a", "x2", "d", 5)]).write.mode("append").parquet(source)
    assert {r.url: r.html for r in ingest(spark, source, root).collect()} == {"a": "x2", "b": "y"}
    assert {r.url: r.html for r in ingest(spark, source, root).collect()} == {"a": "x2", "b": "y"}


def test_joined_equals_the_standard_library(spark):
    """References resolved and queries sorted as the standard library does it."""
    from urllib.parse import parse_qs, urlencode, urljoin, urlsplit

    bases = ["https://h.x/a/b/c", "https://h.x/a/b/", "https://h.x", "http://H.x/a?q=1#f", "https://h.x/a//b/c"]
    hrefs = ["?page=2", "../up", "../../../top", "x", "./x", "x/../y", "..", ".", "x/./y/", "g;p?y#s", "../x?b=2&a=1", "x//y"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    got = {(r.base, r.href): r.full for r in rows.select("*", links.absolute(F.col("href"), F.col("base")).alias("full")).collect()}
    assert got == {(b, h): urljoin(b, h).split("#")[0] for b in bases for h in hrefs}
    others = spark.createDataFrame([("https://h.x/a", h) for h in ("data:text/x", "mailto:a@b", "/r", "http://o/p")], "base string, href string")
    assert [r[0] for r in others.select(links.absolute(F.col("href"), F.col("base"))).collect()] == ["data:text/x", "mailto:a@b", "https://h.x/r", "http://o/p"]
    asked = ["b=2&a=1&b=1", "a", "a=&&b", "x=%C3%A9+y&A=~*", "k=a%3Db", "q=1=2", "é=ü"]
    found = spark.createDataFrame([(q,) for q in asked], "q string").select("q", urls.sorted_query(F.col("q")).alias("s")).collect()
    assert {r.q: r.s for r in found} == {q: urlencode(sorted(parse_qs(q, keep_blank_values=True).items()), doseq=True) for q in asked}
    assert urlsplit(got[bases[0], "../up"]).path == "/a/up"


def test_article_lists_are_closed(spark):
    modern = '<ul><li><a href="/wiki/Menu">m</a></ul><div class="x category-page__members"><div><a href="/wiki/A&amp;B">a</a><a href="/wiki/Category:C">c</a></div><a href="http://h.x/wiki/D?x=1&amp;a=2">d</a></div><a href="/wiki/Privacy">p</a><div class="category-page__members"><a href="/wiki/Second">s</a></div>'
    older = '<div class="mw-category"><div class="mw-category-group"><a href="/wiki/E">e</a></div><a href="http://h.x/wiki/F">f</a></div><a href="/wiki/G">g</a><ul class="mw-category-group"><li><ul><a href="/wiki/H">h</a></ul></li></ul><a href="/wiki/I">i</a>'
    rows = spark.createDataFrame([("https://h.x/c", modern), ("https://h.x/o", older), ("https://h.x/n", "<p>categories</p>")], "url string, html string")
    got = {(r.url[-1], r.link) for r in links.article_links(rows).collect()}
    assert got == {("c", "https://h.x/wiki/A&B"), ("c", "http://h.x/wiki/D?a=2&x=1"), ("o", "https://h.x/wiki/E"), ("o", "https://h.x/wiki/H")}
    following = [
        ('<a class="mw-nextlink" href="/w?title=X&amp;pagefrom=Y">n</a>', "https://h.x/w?pagefrom=Y&title=X"),
        ('<a href="rel">next 5</a><a href="/z">Next 200</a>', "https://h.x/z"),
        ('<a href="javascript:x">next 5</a>', None),
    ]
    for page, link in following:
        assert one(spark, links.next_page(F.lit(page), F.lit("https://h.x/l"))) == link
