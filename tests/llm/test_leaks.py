import random

import pytest

from loresift.llm.leaks import Matcher, leaked, leaked_spans, normalised

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, qid int, lang string, text string"


def brute(docs, items, n=12):
    found = set()
    for item, text in items:
        words = normalised(text or "")
        windows = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        for doc, own in docs:
            w = normalised(own or "")
            if any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1)):
                found.add((doc, item))
    return found


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    words = ["Straße", "été", "дом", "水塔", "dog", "cat's", "x1y", "run", "HILL", "bay"] + [f"w{c}{d}" for c in "abcdef" for d in "uvwxyz"]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(5, 40)))) for k in range(30)]
    items += [(30, items[0][1] + " more and more"), (31, None), (32, ""), (33, "a b c d e f g h i j k l")]
    docs = []
    for k in range(150):
        own = rng.choices(words, k=rng.randint(0, 60))
        if k % 3:
            source = items[rng.randrange(31)][1].split()
            at, n = rng.randrange(len(source)), rng.randint(5, 25)
            own[len(own) // 2 : len(own) // 2] = [w.upper() + rng.choice([",", "", " 7", "\n"]) for w in source[at : at + n]]
        docs.append((k, " ".join(own)))
    return [*docs, (900, None), (901, ""), (902, "a b c d e f g h i j k"), (903, "0 a b c-d e f g h i j k l"), (904, "z " * 300_000)], items


@pytest.mark.parametrize("block_chars", [32 << 20, 900])
def test_equals_brute_force(spark, data, block_chars):
    docs, items = data
    left = spark.createDataFrame([(*d, "clash") for d in docs + docs[:9]], DOCS)
    right = spark.createDataFrame([(i, None, "en", t) for i, t in items] + [(None, 1, "en", "x")], ITEMS)
    got = [tuple(r) for r in leaked(left, right, block_chars=block_chars).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)
    for r in leaked_spans(left, right).collect():
        text, item = dict(docs)[r.doc_id], dict(items)[r.item_id]
        part = normalised(text[r.start : r.end])
        assert len(part) == r.words >= 12 and " ".join(part) in " ".join(normalised(item))
    assert leaked(left.limit(0), right).count() == 0 and leaked(left, right.limit(0)).count() == 0


def test_long_run_is_whole():
    text = " ".join(f"w{chr(97 + k)}" for k in range(26))
    assert Matcher([(1, text)], 12).spans("-- " + text.upper() + " end") == {1: (3, 3 + len(text), 26)}
