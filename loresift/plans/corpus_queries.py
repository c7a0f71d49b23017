"""Queries of curation, page store and link operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import curate, links, store
from ..session import staged, table, work_path
from ..streaming.ingest import ingest, ingest_report

#: The moment that ages are counted from.
NOW = 1_790_000_000
SEED_DEPTH = 3


def pages(spark, folder):
    return table(spark, folder, "crawled_pages")


def _urls(spark, folder):
    """Urls of both tables, in all their spellings."""
    return pages(spark, folder).select("url").union(table(spark, folder, "documents").select("url")).where("url IS NOT NULL").distinct()


def url_normalize_export(spark, folder):
    return _urls(spark, folder).select("url", urls.normalize_export(F.col("url")).alias("norm_url"))


def url_normalize_crawl(spark, folder):
    return _urls(spark, folder).select("url", urls.normalize_crawl(F.col("url")).alias("norm_url"))


def url_domain(spark, folder):
    return _urls(spark, folder).select("url", urls.domain(F.col("url")).alias("domain"))


def url_filter(spark, folder):
    u = F.col("url")
    return _urls(spark, folder).select("url", urls.is_noise(u).alias("noise"), urls.is_valid(u).alias("valid"), urls.is_content(u).alias("content"))


def url_whitelist(spark, folder):
    allowed = ["kelashbritun.example", "www.wajartuncor.example"]
    return _urls(spark, folder).select("url", urls.is_valid(F.col("url"), allowed).alias("allowed"))


def url_titles(spark, folder):
    return _urls(spark, folder).select("url", urls.url_to_title(F.col("url")).alias("title"))


def html_clean(spark, folder):
    rows = pages(spark, folder).where("html IS NOT NULL").dropDuplicates(["_id"]).select("_id", html.clean_html(F.col("html")).alias("c"))
    return rows.select("_id", "c.title", F.length("c.text").alias("text_length"), F.md5("c.text").alias("text_md5"))


def informative_docs(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", html.informative(F.col("title"), F.col("text")).alias("informative"))


def challenge_pages(spark, folder):
    rows = pages(spark, folder).select("_id", html.has_captcha(F.col("html"), F.lit(503)).alias("captcha"), html.is_challenge(F.col("html")).alias("challenge"))
    return rows.distinct()


def curate_pages(spark, folder):
    return curate.curate(pages(spark, folder)).select("doc_id", "url", "title", "source", "source_domain", "timestamp", "text_length")


def skip_reasons(spark, folder):
    return curate.skip_report(pages(spark, folder))


def curate_documents(spark, folder):
    """The documents curated as crawled pages are: first good page of a url, dense ids."""
    rows = curate.export(staged(curate.exported_documents(table(spark, folder, "documents")), "cleaned"))
    return rows.select("doc_id", "url", "title", "source", "source_domain", "timestamp", "text_length")


def document_skip_reasons(spark, folder):
    return curate.reason_counts(curate.exported_documents(table(spark, folder, "documents")))


def content_hash(spark, folder):
    """Writes whose stored hash is missing or differs from that of their html."""
    rows = pages(spark, folder).where("html IS NOT NULL").select("_id", F.md5("html").alias("md5"), F.lower("content_hash").alias("stored"))
    return rows.where(~F.col("md5").eqNullSafe(F.col("stored"))).select("_id", "md5").distinct()


def _hashed(spark, folder):
    """Writes with the MD5 of their html in its place, so that no html is exchanged."""
    return pages(spark, folder).where("html IS NOT NULL").select("url", "source_domain", "_id", "timestamp", F.md5("html").alias("hash"))


def upsert_latest(spark, folder):
    return store.latest(_hashed(spark, folder)).withColumnRenamed("hash", "md5")


def change_detection(spark, folder):
    """Which exported pages are missing, changed or stale when the log's latest writes are fetched."""
    entries = table(spark, folder, "export_entries")
    stored = entries.groupBy("url", "source_domain").agg(F.max(F.struct("run_id", "timestamp", "content_hash")).alias("e")).select("url", "source_domain", "e.content_hash", "e.timestamp")
    return store.needs_update(stored, store.latest(_hashed(spark, folder)), NOW)


def page_lookup(spark, folder):
    """The stored page whose url comes first; both of its keys are asked for."""
    first = pages(spark, folder).where("url IS NOT NULL AND source_domain IS NOT NULL").agg(F.min(F.struct("url", "source_domain")).alias("k")).first().k
    if first is None:
        return pages(spark, folder).limit(0).select("url", "source_domain", "_id")
    stored = store.latest(pages(spark, folder).select("url", "source_domain", "_id", "timestamp"))
    return store.lookup(stored, first.url, first.source_domain).select("url", "source_domain", "_id")


def count_by_source(spark, folder):
    return store.count_by_source(pages(spark, folder).select("_id", "source_domain").distinct())


def docs_per_day(spark, folder):
    return store.docs_per_day(pages(spark, folder).select("_id", "timestamp").distinct())


def latest_pages(spark, folder):
    return store.latest_n(pages(spark, folder))


def backfill_domain(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "url", "source_domain")
    return store.backfill_domain(rows, urls.domain(F.col("url"))).select("doc_id", "source_domain")


def crawl_progress(spark, folder):
    """Saved crawler states with their share of categories done; site crawlers have none."""
    rows = table(spark, folder, "crawl_state")
    done = F.round(F.try_divide(F.col("current_category_index"), F.col("total_categories")), 6)
    return rows.select("_id", "pages_crawled", "pages_updated", "pages_skipped", F.size("categories").alias("n_categories"), done.alias("done"))


def crawl_resume(spark, folder):
    """Where every crawler goes on, from states that were saved and read back."""
    states = store.StateStore(spark, work_path(spark, "states"))
    states.save(table(spark, folder, "crawl_state"))
    return store.resume_points(states.read())


def ingest_counters(spark, folder):
    """A store filled from the older half of the writes meets all of them."""
    rows = pages(spark, folder)
    middle = rows.agg(F.expr("percentile(timestamp, 0.5)").cast("long").alias("m")).first().m or 0
    root = work_path(spark, "counters")
    store.PageStore(spark, root).upsert(rows.where((F.col("timestamp") < middle) | F.col("timestamp").isNull()))
    return ingest_report(spark, f"{folder}/crawled_pages.parquet", root, NOW, max_age_days=100_000)


def sorted_pages(spark, folder):
    """All writes in the order of url and id, numbered."""
    rows = pages(spark, folder).where("url IS NOT NULL").select("_id", "url").distinct()
    return curate.dense_ids(rows, ["url", "_id"], "place")


def link_extract(spark, folder):
    return links.extract_links(pages(spark, folder))


def link_domains(spark, folder):
    found = links.extract_links(pages(spark, folder))
    return found.groupBy(urls.domain(F.col("link")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


#: Documents that a made listing names.
LISTED = 50


def with_listings(spark, folder):
    """``url, html`` of all crawled pages, and of listings as wikis have them: the crawl holds none, so the
    documents of every source are listed, fifty on a page."""
    rows = table(spark, folder, "documents").where("source_domain IS NOT NULL").select("source_domain", "doc_id", F.expr(f"doc_id div {LISTED}").alias("k"))
    items = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<li><a href="/wiki/Page_'), "doc_id", F.lit('?b=1&amp;a=2">item</a></li>')))), "")
    made = rows.groupBy("source_domain", "k").agg(items.alias("items")).select(
        F.concat(F.lit("https://"), "source_domain", F.lit("/wiki/Category:All/"), "k").alias("url"),
        F.concat(
            F.lit('<html><body><ul><li><a href="/wiki/Main">Main</a></li></ul><div class="page category-page__members"><div><ul>'), "items", F.lit('</ul></div><a href="/wiki/Special:Random">random</a></div>'),
            F.lit('<a href="/wiki/Category:Sub_'), F.expr("k % 7"), F.lit('">sub</a><a class="mw-nextlink" href="/index.php?title=Category:All&amp;pagefrom='), F.expr("k + 1"), F.lit('">next 50</a>'),
            F.lit('<div><a href="/wiki/Privacy">privacy</a></div></body></html>'),
        ).alias("html"),
    )
    return pages(spark, folder).select("url", "html").unionByName(made)


def category_link_extract(spark, folder):
    return links.category_links(with_listings(spark, folder))


def article_link_extract(spark, folder):
    return links.article_links(with_listings(spark, folder))


def pagination_next(spark, folder):
    rows = with_listings(spark, folder).where("html IS NOT NULL").select("url", links.next_page(F.col("html"), F.col("url")).alias("next")).distinct()
    return rows.where("next IS NOT NULL")


#: Forms of references that a page may hold.
FORMS = ["/r", "?page=2", "../up", "x/./y", "http://o.example/p/?b=2&a=1", "mailto:a@b", "z#f"]


def link_resolve(spark, folder):
    """Every form of reference, resolved against every url of the documents and normalised."""
    bases = table(spark, folder, "documents").where(urls.is_valid(F.col("url"))).select("url").distinct()
    rows = bases.select("url", F.explode(F.array(*map(F.lit, FORMS))).alias("href"))
    return rows.select("url", "href", urls.normalize_crawl(links.absolute(F.col("href"), F.col("url"))).alias("link"))


def bfs_frontier(spark, folder):
    """Depths from the smallest url of every source, over the links of all pages."""
    rows = pages(spark, folder)
    edges = staged(links.extract_links(rows), "edges")
    seeds = rows.groupBy("source_domain").agg(F.min("url").alias("url"))
    return links.frontier(edges, seeds, SEED_DEPTH)


def stream_ingest(spark, folder):
    return ingest(spark, f"{folder}/crawled_pages.parquet").select("url", "source_domain", "_id", "content_hash")


QUERIES = {
    f.__name__: f
    for f in (
        url_normalize_export, url_normalize_crawl, url_domain, url_filter, url_whitelist, url_titles, html_clean, informative_docs, challenge_pages,
        curate_pages, curate_documents, skip_reasons, document_skip_reasons, content_hash, upsert_latest, change_detection, page_lookup, count_by_source, docs_per_day, latest_pages,
        backfill_domain, crawl_progress, link_extract, link_domains, category_link_extract, article_link_extract, pagination_next, link_resolve, bfs_frontier, crawl_resume, ingest_counters, sorted_pages,
        stream_ingest,
    )
}

_URLS = "WITH u AS (SELECT url FROM crawled_pages WHERE url IS NOT NULL UNION SELECT url FROM documents WHERE url IS NOT NULL)"
_URI = urls.URI.replace("'", "''")


def _p(column: str, k: int) -> str:
    return f"coalesce(regexp_extract({column}, '{_URI}', {k}), '')"


def _norm(column: str, path: str, empty: str) -> str:
    scheme, host = f"lower({_p(column, 1)})", f"lower({_p(column, 2)})"
    return (
        f"CASE WHEN {column} = '' THEN '' ELSE (CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END) || (CASE WHEN {host} <> '' THEN '//' || {host} ELSE '' END)"
        f" || (CASE WHEN {path} = '' THEN '{empty}' WHEN {path} = '/' THEN '/' ELSE regexp_replace({path}, '/+$', '') END) END"
    )


_EXPORT_PATH = f"regexp_replace(regexp_replace({_p('trim(url)', 3)}, ';[^/]*$', ''), '/{{2,}}', '/', 'g')"
_LATEST = """
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, source_domain ORDER BY timestamp DESC NULLS LAST, _id DESC) AS rn
  FROM crawled_pages WHERE html IS NOT NULL) WHERE rn = 1)"""
_ANCHOR = links.ANCHOR.replace("'", "''")
_CONTENT = " OR ".join(f"contains(lower(link), '{p}')" for p in urls.NO_CONTENT)
_BASE_FOLDER = f"regexp_replace({_p('url', 3)}, '[^/]*$', '')"
_ABSOLUTE = (
    f"CASE WHEN starts_with(href, '/') THEN 'https://' || lower({_p('url', 2)}) || href WHEN starts_with(href, 'http') THEN href"
    f" ELSE {_p('url', 1)} || '://' || {_p('url', 2)} || CASE WHEN {_BASE_FOLDER} = '' THEN '/' ELSE {_BASE_FOLDER} END || href END"
)
#: Links without a query string; the test pages have no other.
_EDGES = f"""
h AS (SELECT DISTINCT url, trim(replace(unnest(regexp_extract_all(html, '{_ANCHOR}', 1)), '&amp;', '&')) AS href FROM crawled_pages WHERE html IS NOT NULL),
a AS (SELECT url, {_ABSOLUTE} AS full_url FROM h WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')),
e0 AS (SELECT DISTINCT url, {_norm("full_url", _p("full_url", 3), "")} AS link FROM a),
edges AS (SELECT url, link FROM e0 WHERE link <> '' AND lower({_p("link", 1)}) IN ('http', 'https') AND {_p("link", 2)} <> '' AND NOT ({_CONTENT}))"""

_HOST = f"regexp_replace(lower({_p('url', 2)}), '^www\\.', '')"

_CAPTCHA, _CHALLENGE, _INTERSTITIAL = (" OR ".join(f"contains(lower(html), '{x}')" for x in signs) for signs in (html.CAPTCHA, html.CHALLENGE, html.INTERSTITIAL))
#: Of the documents' urls: key and value pairs decoded, in order, encoded anew.
_QUERY = """array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''),
  lambda x, i: {'k': url_decode(string_split(x, '=')[1]), 'i': i, 'v': url_decode(CASE WHEN contains(x, '=') THEN x[position('=' IN x) + 1:] ELSE '' END)})),
  lambda p: url_encode(p.k) || '=' || url_encode(p.v)), '&')"""
_LISTING = f"l AS (SELECT lower(source_domain) AS host, source_domain, doc_id, doc_id // {LISTED} AS k FROM documents WHERE source_domain IS NOT NULL)"
_LISTING_URL = "'https://' || source_domain || '/wiki/Category:All/' || k"
_DIRECTORY = f"regexp_replace({_p('url', 3)}, '[^/]*$', '')"
_ROOT = f"lower({_p('url', 1)}) || '://' || lower({_p('url', 2)})"

_NOISE = f"(n = '' OR regexp_matches(lower(n), '\\.({'|'.join(urls.MEDIA)})$') OR {' OR '.join(f"contains(lower(n), '{p}')" for p in urls.NOISE)})"
_CURATED = f"""WITH k AS (SELECT *, CASE WHEN url IS NULL THEN '' ELSE {_norm("trim(url)", _EXPORT_PATH, "/")} END AS n, doc_id::VARCHAR AS id, coalesce(url, '') AS u,
    regexp_extract_all(text, '[a-zA-Z]{{3,}}') AS w FROM documents),
  f AS (SELECT *, coalesce(length(text) >= 350 AND len(w) >= 60 AND len(list_distinct(w)) >= 0.12 * len(w) AND length(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) >= 3, FALSE) AS good FROM k),
  o AS (SELECT *, coalesce(max(good::INT) OVER (PARTITION BY n ORDER BY u, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
  r AS (SELECT *, CASE WHEN {_NOISE} THEN 'noise' WHEN before = 1 THEN 'duplicate' WHEN good THEN 'exported' ELSE 'low_quality' END AS reason FROM o)"""

SQL = {
    "crawl_resume": """SELECT _id, coalesce(current_category_index, 0) AS category_index, coalesce(current_article_index, 0) AS article_index,
      categories[coalesce(current_category_index, 0) + 1] AS category_url, categories IS NOT NULL AND coalesce(current_category_index, 0) >= len(categories) AS finished FROM crawl_state""",
    "ingest_counters": """WITH w AS (SELECT *, md5(html) AS h FROM crawled_pages WHERE html IS NOT NULL),
      m AS (SELECT floor(quantile_cont(timestamp, 0.5))::BIGINT AS m FROM crawled_pages),
      a AS (SELECT url, source_domain, h, row_number() OVER (PARTITION BY url, source_domain ORDER BY timestamp DESC NULLS LAST, _id DESC) AS rn FROM w),
      b AS (SELECT url, source_domain, h, row_number() OVER (PARTITION BY url, source_domain ORDER BY timestamp DESC NULLS LAST, _id DESC) AS rn FROM w, m WHERE timestamp < m.m OR timestamp IS NULL)
      SELECT count(*) AS crawled, count(*) FILTER (b.h IS DISTINCT FROM a.h) AS updated, count(*) FILTER (b.h IS NOT DISTINCT FROM a.h) AS skipped
      FROM a LEFT JOIN b ON a.url = b.url AND a.source_domain = b.source_domain AND b.rn = 1 WHERE a.rn = 1""",
    "sorted_pages": "SELECT _id, url, row_number() OVER (ORDER BY url, _id) - 1 AS place FROM (SELECT DISTINCT _id, url FROM crawled_pages WHERE url IS NOT NULL)",
    "curate_documents": _CURATED
    + """ SELECT row_number() OVER (ORDER BY url, id) - 1 AS doc_id, n AS url, title, coalesce(source, 'Unknown') AS source, coalesce(source_domain, 'unknown') AS source_domain,
      coalesce(timestamp, 0) AS timestamp, length(text)::INT AS text_length FROM r WHERE reason = 'exported'""",
    "document_skip_reasons": _CURATED + " SELECT reason, count(*) AS n FROM r GROUP BY reason",
    "url_normalize_crawl": f"""{_URLS}, s AS (SELECT url, {_norm("url", _p("url", 3), "")} AS base, {_p("url", 4)} AS q FROM u)
      SELECT url, base || CASE WHEN q = '' THEN '' ELSE '?' || {_QUERY} END AS norm_url FROM s""",
    "url_titles": f"""{_URLS}, p AS (SELECT url, {_p("url", 3)} AS path FROM u)
      SELECT url, replace(url_decode(CASE WHEN contains(path, '/wiki/') THEN path[position('/wiki/' IN path) + 6:] ELSE trim(path, '/') END), '_', ' ') AS title FROM p""",
    "challenge_pages": f"""SELECT DISTINCT _id, coalesce({_CAPTCHA} OR {_CHALLENGE}, FALSE) AS captcha, coalesce({_INTERSTITIAL}, FALSE) AS challenge FROM crawled_pages""",
    "page_lookup": f"""WITH last AS (SELECT *, row_number() OVER (PARTITION BY url, source_domain ORDER BY timestamp DESC NULLS LAST, _id DESC) AS rn FROM crawled_pages
      WHERE url IS NOT NULL AND source_domain IS NOT NULL) SELECT url, source_domain, _id FROM last WHERE rn = 1 ORDER BY url, source_domain LIMIT 1""",
    "category_link_extract": f"WITH {_LISTING} SELECT DISTINCT {_LISTING_URL} AS url, 'https://' || host || '/wiki/Category:Sub_' || (k % 7) AS link FROM l",
    "article_link_extract": f"WITH {_LISTING} SELECT DISTINCT {_LISTING_URL} AS url, 'https://' || host || '/wiki/Page_' || doc_id || '?a=2&b=1' AS link FROM l",
    "pagination_next": f"WITH {_LISTING} SELECT DISTINCT {_LISTING_URL} AS url, 'https://' || host || '/index.php?pagefrom=' || (k + 1) || '&title=Category%3AAll' AS next FROM l",
    "link_resolve": f"""WITH b AS (SELECT DISTINCT url, {_ROOT} AS root, {_p("url", 3)} AS path, {_DIRECTORY} AS dir FROM documents
        WHERE lower({_p("url", 1)}) IN ('http', 'https') AND {_p("url", 2)} <> ''),
      d AS (SELECT url, root, path, CASE WHEN dir = '' THEN '/' ELSE regexp_replace(dir, '/{{2,}}', '/', 'g') END AS dir FROM b)
      SELECT url, '/r' AS href, 'https://' || split_part(root, '://', 2) || '/r' AS link FROM d
      UNION ALL SELECT url, '?page=2', root || CASE WHEN path = '/' THEN '/' ELSE rtrim(path, '/') END || '?page=2' FROM d
      UNION ALL SELECT url, '../up', root || regexp_replace(dir, '[^/]+/$', '') || 'up' FROM d
      UNION ALL SELECT url, 'x/./y', root || dir || 'x/y' FROM d
      UNION ALL SELECT url, 'http://o.example/p/?b=2&a=1', 'http://o.example/p?a=1&b=2' FROM d
      UNION ALL SELECT url, 'mailto:a@b', 'mailto:a@b' FROM d
      UNION ALL SELECT url, 'z#f', root || dir || 'z' FROM d""",
    "stream_ingest": f"WITH {_LATEST} SELECT url, source_domain, _id, md5(html) AS content_hash FROM last",
    "url_normalize_export": f"{_URLS} SELECT url, {_norm('trim(url)', _EXPORT_PATH, '/')} AS norm_url FROM u",
    "url_domain": f"{_URLS} SELECT url, lower({_p('url', 2)}) AS domain FROM u",
    "url_filter": f"""{_URLS} SELECT url, (url = '' OR regexp_matches(lower(url), '\\.({"|".join(urls.MEDIA)})$') OR {" OR ".join(f"contains(lower(url), '{p}')" for p in urls.NOISE)}) AS noise,
      lower({_p("url", 1)}) IN ('http', 'https') AND {_p("url", 2)} <> '' AS valid, NOT ({_CONTENT.replace("link", "url")}) AS content FROM u""",
    "url_whitelist": f"""{_URLS} SELECT url, lower({_p("url", 1)}) IN ('http', 'https') AND {_p("url", 2)} <> ''
      AND ({_HOST} IN ('kelashbritun.example', 'wajartuncor.example') OR ends_with({_HOST}, '.kelashbritun.example') OR ends_with({_HOST}, '.wajartuncor.example')) AS allowed FROM u""",
    "informative_docs": """WITH w AS (SELECT doc_id, title, text, regexp_extract_all(text, '[a-zA-Z]{3,}') AS w FROM documents)
      SELECT doc_id, coalesce(length(text) >= 350 AND len(w) >= 60 AND len(list_distinct(w)) >= 0.12 * len(w) AND length(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) >= 3, FALSE) AS informative FROM w""",
    "content_hash": "SELECT DISTINCT _id, md5(html) AS md5 FROM crawled_pages WHERE html IS NOT NULL AND md5(html) IS DISTINCT FROM lower(content_hash)",
    "upsert_latest": f"WITH {_LATEST} SELECT url, source_domain, _id, timestamp, md5(html) AS md5 FROM last",
    "change_detection": f"""WITH {_LATEST},
      s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, source_domain ORDER BY run_id DESC, timestamp DESC NULLS LAST, content_hash DESC) AS rn FROM export_entries) WHERE rn = 1),
      j AS (SELECT l.url, l.source_domain, CASE WHEN s.run_id IS NULL THEN 'missing' WHEN md5(l.html) IS DISTINCT FROM lower(s.content_hash) THEN 'changed'
        WHEN {NOW} - coalesce(s.timestamp, 0) > 30 * 86400 THEN 'stale' END AS reason FROM last l LEFT JOIN s ON s.url = l.url AND s.source_domain = l.source_domain)
      SELECT url, source_domain, reason FROM j WHERE reason IS NOT NULL""",
    "count_by_source": "SELECT source_domain, count(DISTINCT _id) AS n FROM crawled_pages GROUP BY source_domain",
    "docs_per_day": "SELECT strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT DISTINCT _id, timestamp FROM crawled_pages) WHERE timestamp IS NOT NULL GROUP BY day",
    "latest_pages": "SELECT DISTINCT _id, url, timestamp FROM crawled_pages ORDER BY timestamp DESC NULLS LAST, _id DESC LIMIT 10",
    "backfill_domain": f"SELECT doc_id, coalesce(source_domain, lower({_p('url', 2)})) AS source_domain FROM documents",
    "crawl_progress": "SELECT _id, pages_crawled, pages_updated, pages_skipped, len(categories)::INT AS n_categories, round(current_category_index / nullif(total_categories, 0), 6) AS done FROM crawl_state",
    "link_extract": f"WITH {_EDGES} SELECT url, link FROM edges",
    "link_domains": f"WITH {_EDGES} SELECT lower({_p('link', 2)}) AS domain, count(*) AS n FROM edges GROUP BY 1",
    "bfs_frontier": f"""WITH RECURSIVE {_EDGES}, seeds AS (SELECT min(url) AS url FROM crawled_pages GROUP BY source_domain),
      walk AS (SELECT url, 0 AS depth FROM seeds UNION SELECT e.link, w.depth + 1 FROM walk w JOIN edges e ON e.url = w.url WHERE w.depth < {SEED_DEPTH})
      SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url""",
}
