import random
from collections import defaultdict

import pytest

from loresift.llm import lines
from loresift.llm.suffix import common_prefixes, maximal_runs, prefix_hash, repeated_places

SCHEMA = "doc_id long, source_domain string, text string, grp long, symbols string"


def brute(rows, min_docs=5):
    import re

    seen = defaultdict(set)
    key = lambda x: re.sub("[0-9]+", "0", " ".join(x.lower().split()))
    for doc, domain, text in rows:
        for line in (text or "").split("\n"):
            if domain is not None and len(key(line)) >= 25:
                seen[(domain, key(line))].add(doc)
    return {
        (doc, k) for doc, domain, text in rows if domain is not None and text for k, line in enumerate(text.split("\n"), 1) if len(seen.get((domain, key(line)), ())) >= min_docs
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stock = [f"This Legal Notice   number {k} is shown on every page" for k in range(12)]
    out = []
    for doc in range(300):
        domain = rng.choice(["hot"] * 6 + ["a", "b", None])
        own = [f"A line of its own, long enough to count, {rng.random():.9f}".replace("0.", rng.choice("abcdef")) for _ in range(rng.randint(0, 3))]
        own += [rng.choice(stock).replace("number", f"number {rng.randint(0, 99)}") for _ in range(rng.randint(0, 2))]
        own += ["short", ""][: rng.randint(0, 2)]
        rng.shuffle(own)
        out.append((doc, domain, "\n".join(own)))
    return [*out, (900, "a", None), (901, "a", ""), (902, "a", "x" * 100_000), *[(doc, d, t) for doc, d, t in out[:20]]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("bundle_rows", [200_000, 7])
def test_repeated_lines(spark, rows, bundle_rows):
    """Also where the suffixes of a common line are dealt over many parts."""
    found = lines.repeated_lines(frame(spark, rows), bundle_rows=bundle_rows, parts=5)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_clean_text_keeps_the_rest(spark, rows):
    gone = brute(rows)
    got = {r.doc_id: r.text for r in lines.without_repeated_lines(frame(spark, rows[:303])).collect()}
    assert len(got) == 303 and got[900] is None and got[901] == ""
    for doc, _, text in rows[:303]:
        if text:
            assert got[doc] == "\n".join(x for k, x in enumerate(text.split("\n"), 1) if (doc, k) not in gone)


def test_empty(spark, rows):
    assert lines.repeated_lines(frame(spark, rows).limit(0)).count() == 0
    assert lines.maximal_blocks(frame(spark, rows).limit(0)).count() == 0


def test_multi_line_blocks(spark):
    a, b, c = (f"a line that is repeated in many documents {x}" for x in "xyz")
    rows = [(k, "s", f"own text of document, long enough {chr(97 + k)}\n{a}\n{b}\n{c}") for k in range(6)] + [(9, "s", f"{b}\n{c}")]
    got = sorted((r.length, r.documents) for r in lines.maximal_blocks(frame(spark, rows)).collect())
    assert got == [(2, 7), (3, 6)]


def test_blocks_of_one_start(spark):
    """Notices that rotate after the same line are blocks of their own."""
    lead = "a line that opens every one of the notices"
    tails = [f"a line that closes the notice {x}" for x in "xyz"]
    rows = [(k, "s", f"{lead}\n{tails[k % 3]}") for k in range(18)]
    got = [(r.length, r.documents) for r in lines.maximal_blocks(frame(spark, rows)).collect()]
    assert got == [(2, 6)] * 3


def brute_runs(docs, least):
    """Occurrences of every run, by looking at all of them."""
    seen = defaultdict(list)
    for grp, doc, symbols in docs:
        for at in range(len(symbols)):
            for end in range(at + 1, len(symbols) + 1):
                if None in symbols[at:end]:
                    break
                seen[(grp, tuple(symbols[at:end]))].append((doc, symbols[at - 1] if at else None, symbols[end] if end < len(symbols) else None))
    return {k: v for k, v in seen.items() if len({d for d, _, _ in v}) >= least}


@pytest.mark.parametrize("bundle_rows", [1_000_000, 3])
def test_runs_equal_counting(spark, bundle_rows):
    """Also where the suffixes of a common symbol are dealt over many parts."""
    rng = random.Random(11)
    docs = [(rng.randint(0, 1), doc, [rng.choice([1, 2, 3, 4, None]) for _ in range(rng.randint(0, 9))]) for doc in range(60)]
    docs += [(0, doc, [doc, 5, *range(20, 45), 6]) for doc in range(100, 106)]
    runs = brute_runs(docs, 4)
    frame = spark.createDataFrame(docs, "grp long, doc long, symbols array<long>")
    found = common_prefixes(repeated_places(frame, 4), 4, bundle_rows=bundle_rows, parts=3)
    got = {(r.grp, r.prefix, r.length): (r.documents, r.occurrences) for r in maximal_runs(found).collect()}

    def extends(side):
        return None not in side and len(side) == 1

    want = {
        (grp, prefix_hash(run), len(run)): (len({d for d, _, _ in own}), len(own))
        for (grp, run), own in runs.items()
        if len(run) > 1 and not extends({b for _, b, _ in own}) and not extends({a for _, _, a in own})
    }
    assert got == want and (0, prefix_hash([5, *range(20, 45), 6]), 27) in got
    single = {(r.grp, r.first): r.documents for r in found.where("length = 1").collect()}
    assert single == {(grp, run[0]): len({d for d, _, _ in own}) for (grp, run), own in runs.items() if len(run) == 1}


def test_long_notice(spark):
    """One notice of twelve lines is one block."""
    notice = "\n".join(f"line {x} of the notice that stands below every page" for x in "abcdefghijkl")
    rows = [(k, "s", f"own text of document, long enough {chr(97 + k)}\n{notice}\nanother own line of this one {chr(97 + k)}") for k in range(7)]
    got = [(r.length, r.documents, r.occurrences) for r in lines.maximal_blocks(frame(spark, rows)).collect()]
    assert got == [(12, 7, 7)]
    gone = {r.doc_id: r.text for r in lines.without_repeated_lines(frame(spark, rows)).collect()}
    assert all(len(t.split("\n")) == 2 for t in gone.values())
