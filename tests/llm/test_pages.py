import random

import numpy as np
import pytest

from loresift.llm import main_text, residue, tokenruns
from loresift.llm.pages import parse
from loresift.llm.residue import SLOT, ExemplarIndex, terms

PAGE = "_id string, url string, html string, source string, source_domain string, timestamp long, content_hash string, grp string"
SIDE = '<div class="box"><h3>{n} comments</h3><div class="c"><b>user{k}</b> wrote:<p>Remark {k} that nobody else made about it.</p></div></div>'


def site(k, body):
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "Maps", "News"))
    return (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><script>var a='</p>';</script><ul>{menu}</ul><div id='main'><h1>Page {k}</h1>{body}{SIDE.format(n=k, k=k)}</div>"
        f"<p>Viewed {k * 37} times</p><div><a>© 2020 X</a> | <a>Imprint</a></div></body></html>"
    )


BODIES = [f"<h2>History</h2><p>Text {'abcdefghijklmnopqrstuvwxyz'[k % 26]}{k} &amp; <b>bo</b>ld.</p><ul><li>item of {chr(97 + k // 20)}{chr(97 + k % 20)}vor</li></ul>" for k in range(40)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(f"{k}", f"u{k}", site(k, BODIES[k]), None, "h", k, None) for k in range(40)]
    rows += [("40", "e1", site(40, "<p>This page does not exist.</p>"), None, "h", None, None), ("40", "e1", site(40, "<p>This page does not exist.</p>"), None, "h", None, None)]
    rows += [("41", "n", None, "s", "h", 1, None), ("42", "one", site(1, "<p>Alone</p>"), None, "single", 1, None), ("43", None, "", None, None, None, None), ("44", "x", "<p>" + "y " * 100_000, None, None, 2, None)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGE)


def test_blocks():
    blocks, boxes = parse("<head><title>t</title></head><p>One <b>t</b>wo<i> x</i><br>three<!-- c --> four<p>five &lt;&nbsp;<script>no</script><noscript>no</noscript></div><td>six")
    assert [b.text for b in blocks] == ["One two x", "three four", "five <", "six"]
    assert [b.text for b in parse("<!-- open <p>x")[0]] == [] and parse("")[0] == [] and parse("plain")[0][0].text == "plain"
    assert boxes[0].last == len(blocks) - 1


def test_main_body(spark, pages):
    texts = {r._id: r.text for r in main_text.main_texts(pages).collect()}
    assert set(texts) == {*map(str, range(41)), "42", "43", "44"}
    for k in range(40):
        assert f"Text {'abcdefghijklmnopqrstuvwxyz'[k % 26]}{k} & bold." in texts[str(k)]
        assert f"item of {chr(97 + k // 20)}{chr(97 + k % 20)}vor" in texts[str(k)]
        assert "Remark" not in texts[str(k)] and "Viewed" not in texts[str(k)] and "Imprint" not in texts[str(k)] and "Home" not in texts[str(k)]
    assert "This page does not exist." in texts["40"]
    assert "Alone" in texts["42"] and "Home" in texts["42"]  # one page shows no boilerplate
    assert texts["43"] == ""


def test_join_path_equals_broadcast(spark, pages):
    table = main_text.parsed(pages)
    covered = main_text.boilerplate(table)
    body = lambda key, blocks, _: [(key, "|".join(b.text for b in blocks))]
    rows = [sorted(map(tuple, main_text.each_main(table, covered, body, "_id string,text string", limit_bytes=limit).collect())) for limit in (1 << 20, 0)]
    assert rows[0] == rows[1]


def test_hashes_and_empty(spark, pages):
    got = [tuple(r) for r in main_text.main_block_hashes(pages).collect()]
    assert len(got) == len(set(got)) and ("42", main_text.block_md5("Alone")) in got
    assert main_text.main_block_hashes(pages.limit(0)).count() == 0


RESIDUE = [
    "<h1>Oops!</h1><p>This link leads nowhere. Use the search instead.</p>", "<p>{{ title }}</p><p>[[body]]</p>", "<p>Lorem ipsum dolor sit amet, consectetur adipiscing elit.</p>",
    "<noscript>Please enable JavaScript to read it.</noscript><div></div>", "<h1>Nam</h1><p>The %%place%% was built in ${year} by @@owner@@.</p><p>Then a real sentence about a dam follows here.</p>",
    "<h1>502 Bad Gateway</h1>front-abcd/1.2", "<p>指定されたページは存在しません。</p>",
]
CLEAN = [
    "<h1>Access Denied (quest)</h1><p>Access Denied is a side quest given by Hulon in the old quarry near the northern gate.</p>",
    '<h1>Terminal 404</h1><p>Terminal 404 shows the words "Page not found" until somebody from the guild repairs it at dawn.</p>',
    "<noscript>Please enable JavaScript.</noscript><h1>Dam</h1><p>The dam keeps three generators and one archive below its eastern wall.</p>",
    "<h1>Help: templates</h1><p>Editors write {{Dam|year}} at the top of an article and fill every field in by hand.</p>", "",
]


def test_residue(spark):
    rows = [(f"r{k}", f"r{k}", h, None, "h", 1, None, "c") for k, h in enumerate(RESIDUE)] + [(f"c{k}", f"c{k}", h, None, "h", 1, None, "c") for k, h in enumerate(CLEAN)]
    rows += [("n", "n", None, None, "h", 1, None, "c"), rows[0]]
    found = [r._id for r in residue.residue_writes(spark.createDataFrame(rows, PAGE)).collect()]
    assert sorted(found) == sorted(f"r{k}" for k in range(len(RESIDUE)))
    assert residue.residue_writes(spark.createDataFrame([], PAGE)).count() == 0


def test_containment():
    index = ExemplarIndex({"page": 5, SLOT: 3}, 1000)
    assert terms("A {{x}} ${y} 12 b2 页面不存在") == ["a", SLOT, SLOT, "b", "页面", "面不", "不存", "存在"]
    assert index.containment(terms("seite nicht gefunden"), 1)[0] == 1.0
    assert index.containment(terms("the seite of our northern quarry"), 1)[0] < 0.5


def plain(k, body, footer="<div><a>© 2020 X</a> | <a>Imprint</a></div>"):
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "Maps", "News"))
    return f"<html><body><ul>{menu}</ul><div id='main'>{body}{SIDE.format(n=k, k=k)}</div><p>Viewed {k * 37} times</p>{footer}</body></html>"


def kept(spark, bodies):
    rows = [(f"{k}", f"u{k}", plain(k, b), None, "h", k, None, "c") for k, b in enumerate(bodies)]
    texts = {int(r._id): r.text.split("\n") for r in main_text.main_texts(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(not {"Home", "Imprint", f"{k} comments", f"Viewed {k * 37} times"} & set(texts[k]) for k in texts)
    return texts


def word(k):
    return f"{chr(97 + k // 20)}{chr(97 + k % 20)}vor"


def test_shared_headings(spark, pages):
    texts = {r._id: r.text.split("\n") for r in main_text.main_texts(pages).collect()}
    assert all("History" in texts[str(k)] for k in range(40))
    got = kept(spark, [f"<h1>{word(k)}</h1><p>Intro {word(k)}.</p><section><h2>Loot</h2><p>Loot of {word(k)}.</p><h3>Bugs</h3><p>Bug in {word(k)}.</p></section><div>Layout</div><p>Map of {word(k)}.</p><div><h4>Our blog</h4><p>Teaser {word(k)}</p><div>Read on</div></div>" for k in range(40)])
    for k in range(40):
        assert got[k] == [word(k), f"Intro {word(k)}.", "Loot", f"Loot of {word(k)}.", "Bugs", f"Bug in {word(k)}.", "Layout", f"Map of {word(k)}."]


def test_copied_articles(spark):
    copy = "<h1>Dam</h1><p>The dam is old.</p><h2>Uses</h2><ul><li>Power</li><li>Water</li></ul>"
    got = kept(spark, [copy if k % 3 == 0 else f"<h1>{word(k)}</h1><p>Intro {word(k)}.</p>" for k in range(40)])
    assert all(got[k] == ["Dam", "The dam is old.", "Uses", "Power", "Water"] for k in range(0, 40, 3))


def test_uniform_articles(spark):
    """Blocks that differ in their digits only are the article's own."""
    got = kept(spark, [f"<h1>No. {k}</h1><p>Range: {k}</p><div>Load | {k}</div><dl><dt>Weight</dt><dd>{k} kg</dd></dl><ul><li>item of {k}</li></ul>" for k in range(40)])
    for k in range(40):
        assert got[k] == [f"No. {k}", f"Range: {k}", f"Load | {k}", "Weight", f"{k} kg", f"item of {k}"]


@pytest.mark.parametrize("times", [3, 7])
def test_repeated_residue(spark, times):
    """An error page on a third, and on seven tenths, of a host's urls, with and without a heading."""
    for error in ("<h1>Oops!</h1><p>This link leads nowhere. Use the search instead.</p>", "<p>Lorem ipsum dolor sit amet, consectetur adipiscing elit.</p>"):
        bad = [k for k in range(40) if (k % 3 == 0 if times == 3 else k % 10 < 7)]
        rows = [(f"{k}", f"u{k}", plain(k, error if k in bad else f"<h1>{word(k)}</h1><p>The dam of {word(k)} keeps three generators below its eastern wall.</p>"), None, "h", 1, None, "c") for k in range(40)]
        assert sorted(int(r._id) for r in residue.residue_writes(spark.createDataFrame(rows, PAGE)).collect()) == bad


def test_changing_word(spark):
    """A notice that holds another word on every page: no unit of it repeats, its token runs do."""
    notice = "<div><p>This page was last brought up to date by the editor {w} of the northern circle.</p></div>"
    rows = [(f"{k}", f"u{k}", plain(k, f"<h1>{word(k)}</h1><p>The dam of {word(k)} is old.</p><p>It stands alone.</p>", notice.format(w=word(k + 7))), None, "h", k, None, "c") for k in range(40)]
    texts = {int(r._id): r.text.split("\n") for r in main_text.main_texts(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(texts[k][:2] == [word(k), f"The dam of {word(k)} is old."] and not any("editor" in x for x in texts[k]) for k in range(40))


def brute_pieces(streams, floor):
    """Names of the pieces on at least ``floor`` articles, by looking at every place."""
    held = {}
    for article, stream in streams:
        for at, token in enumerate(stream[:-1]):
            end = stream.index(tokenruns.EDGE, at + 1) + 1
            size = min(end - at, tokenruns.PIECE) if token == tokenruns.EDGE else tokenruns.PIECE
            if at + size <= end:
                held.setdefault(tuple(stream[at : at + size]), set()).add(article)
    flat = [p for p, own in held.items() if len(own) >= floor]
    return {int(tokenruns.names(np.array(p, dtype=np.uint32), np.array([0]), np.array([len(p)]))[0]) for p in flat}


@pytest.mark.parametrize("part_tokens", [1 << 20, 600])
def test_pieces_equal_counting(spark, part_tokens):
    """Also where a host, and one article with many copies, is dealt over many parts."""
    rng = random.Random(3)
    rows, seen = [], {1: [], 2: []}
    notice = [rng.randint(50, 99) for _ in range(14)]
    for doc in range(300):
        grp, article = (1 if doc % 3 else 2), (7 if doc % 4 == 0 else doc)
        stream = [tokenruns.EDGE]
        for _ in range(rng.randint(1, 4)):
            stream += [rng.randint(1, 9) for _ in range(rng.randint(1, 3))] if rng.random() < 0.7 else notice[: rng.randint(6, 14)] + [1000 + doc]
            stream.append(tokenruns.EDGE)
        if article == 7:
            stream += [*range(200, 212), tokenruns.EDGE]
        seen[grp].append((article, stream))
        rows.append((grp, article, doc, len(stream), bytearray(tokenruns.packed(stream))))
    frame = spark.createDataFrame(rows, "grp long, article long, doc long, n_tokens int, tokens binary")
    got = {(r.grp, r.symbol) for r in tokenruns.covered_pieces(frame, 0.05, 3, part_tokens).collect()}
    want = {(g, s) for g, streams in seen.items() for s in brute_pieces(streams, max(3, -(-len({a for a, _ in streams}) // 20)))}
    assert got == want and len(want) > 20


def test_suffix_array():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 400).astype(np.uint32)
    starts = np.arange(0, 400, 3)
    order, lcp = tokenruns.suffix_array(tokens, starts, 6)
    cut = [tuple(tokens[k : k + 8]) for k in order]
    assert sorted(order) == starts.tolist() and [c[:6] for c in cut] == sorted(c[:6] for c in cut)
    for k in range(1, len(order)):
        a, b = cut[k - 1], cut[k]
        same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == same
