import os
import random
from functools import partialmethod

import numpy as np
import pytest

from loresift.llm import quality as q
from loresift.llm import ranks
from loresift.llm.boosting import Trees

PROSE = "The old dam of Vale was closed after the reactor at Harre Point failed, and nobody in the village knows why. It is one of three that were built in those years."
NAMES = "Harre Olvor Benna Tiskel Maro Quil Dorn Ashby Fenn Larke Wyre Stonn Gale Perrin Tam".split()
THINGS = "dam reactor archive tower kiln quarry vault locker engine canister windmill shelter tannery beacon".split()


def prose(k):
    """Sentences that differ from each other."""
    rng = random.Random(k)
    a, b, n = (lambda: rng.choice(NAMES)), (lambda: rng.choice(THINGS)), (lambda: rng.randint(2, 900))
    forms = [
        lambda: f"The old {b()} of {a()} was closed after the {b()} at {a()} Point failed, and nobody in the village knows why.",
        lambda: f"With {n()} crates and a {b()}, {a()} reached the {b()} of {a()} before the winter of year {n()}.",
        lambda: f"It is one of {n()} that were built in those years by {a()}, who also kept the {b()} for the guild.",
        lambda: f"When {a()} came to the {b()}, they found only {n()} plates and a note from {a()}.",
    ]
    return "\n".join(" ".join(rng.choice(forms)() for _ in range(3)) for _ in range(2 + k % 4))


KINDS = {
    "list": "\n".join(f"+ Hollow lantern of {chr(97 + k)}vor" for k in range(24)),
    "table": "Name | Weight | Value\n" + "\n".join(f"map {k} | {k * 7} | {k * 13}" for k in range(20)),
    "fields": "\n".join(f"stamina of beacon {k}: {k * 3}" for k in range(24)),
    "hex": "\n".join("0000 " + " ".join(f"{(k * j) % 256:02x}" for j in range(16)) for k in range(20)),
    "repeats": "terminal zajar denash olfyr " * 60,
    "signs": "\n".join("#+ *# +##* *" * 5 for _ in range(20)),
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, f"Place of Number{k}", prose(k)) for k in range(120)]
    rows += [(200 + k, f"Place {k} Tower", PROSE[:60] + ".\n" + list(KINDS.values())[k % 6] + f"\nrow {k}") for k in range(60)]
    rows += [(300 + k, t, prose(k)) for k, t in enumerate(["0xf9dee998::1", "~~_-#*", "kyakmbmjdbeqgtttev", "M-83a", "No. 75", "VALE DAM", "  ", None])]
    rows += [(400, None, None), (401, "Name", ""), (402, "Name", "x" * 200_000), (0, rows[0][1], rows[0][2])]
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, title string, text string, words double")


def test_junk_is_told_from_prose(documents):
    got = {(r.doc_id, r.field) for r in q.junk_fields(documents).collect()}
    texts = {d for d, f in got if f == "text"}
    assert texts >= {200 + k for k in range(60)} and not texts & set(range(120)) and not texts & set(range(300, 308))
    assert {d for d, f in got if f == "title"} == {300, 301, 302}


def test_statistics_and_nulls(documents):
    rows = q.quality(documents).collect()
    assert len(rows) == documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[400].text_junk is None and by[400].title_junk is None and by[401].text_junk is None and by[306].title_junk is None
    assert by[400].words == 0 and 0 <= by[1].text_junk <= 1 and by[1].prose_share == 1.0
    assert q.quality(documents.limit(0)).count() == 0


def test_holdout_of_all_languages(documents):
    """Trees fitted to the documents of this test, which are English, on texts of ten languages: junk is
    told from prose by its shape."""
    model, _, _ = q.fit_models(documents)
    p = model.probability(np.array([q.text_statistics(t) for t, _ in q.TEXTS])) > 0.5
    assert (p == np.array([y for _, y in q.TEXTS])).mean() > 0.9
    votes = np.array([q.text_vote(dict(zip(q.TEXT_FEATURES, q.text_statistics(t), strict=True))) for t, _ in q.TEXTS])
    y = np.array([v for _, v in q.TEXTS])
    assert ((votes == y) | (votes < 0)).mean() > 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_trees_on_held_out_documents(spark):
    """Fitted to half of the weakly labelled documents, the trees agree with the labels of the rest."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text <> ''").collect()
    x = np.array([q.text_statistics(r.text) for r in rows])
    y = np.array([q.text_vote(dict(zip(q.TEXT_FEATURES, r, strict=True))) for r in x])
    x, y = x[y >= 0], y[y >= 0].astype(float)
    trees = Trees().fit(x[::2], y[::2])
    assert ((trees.probability(x[1::2]) > 0.5) == y[1::2]).mean() > 0.98


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Trees().fit(x[:1000], y[:1000])
    assert ((trees.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    calibrated = trees.calibrate(x[1000:], y[1000:]).probability(x[1000:])
    assert abs(calibrated.mean() - y[1000:].mean()) < 0.02
    assert Trees().fit(np.zeros((4, 2)), np.zeros(4)).probability(np.zeros((1, 2)))[0] < 0.1


@pytest.fixture(scope="module")
def many(spark):
    """Of 4,500 documents, the titles are names of their own and every ninth text is a list."""
    rows = [(k, f"Vale {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}or", prose(k)[:400] if k % 9 else f"+ lantern {k}\n" * (5 + k % 40)) for k in range(4500)]
    return spark.createDataFrame(rows, "doc_id long, title string, text string").repartition(6)


def test_models_are_fitted_to_all_documents(many):
    """Bins, trees and letter pairs are those of all rows, though there are more than 4,000."""
    rows = many.collect()
    text_model, title_model, pairs = q.fit_models(many)
    words = [f"^{w}$" for r in rows for w in r.title.lower().split()]
    total = sum(len(w) - 1 for w in words) + 1000
    assert pairs[""] == np.log(0.5 / total) and pairs["r$"] == np.log((len(rows) + 0.5) / total)
    for model, names, vote, x in (
        (text_model, q.TEXT_FEATURES, q.text_vote, [q.text_statistics(r.text) for r in rows]),
        (title_model, q.TITLE_FEATURES, q.title_vote, [q.title_statistics(r.title, pairs) for r in rows]),
    ):
        y = np.array([vote(dict(zip(names, r, strict=True))) for r in x])
        whole = Trees().fit(np.array(x)[y >= 0], y[y >= 0])
        assert all(np.array_equal(a, b) for a, b in zip(model.edges, whole.edges, strict=True)) and model.base == whole.base
        assert all(np.array_equal(a, b) for t, u in zip(model.trees, whole.trees, strict=True) for a, b in zip(t, u, strict=True))


def test_sums_do_not_depend_on_where_they_are_taken(many, monkeypatch):
    """On the driver, on executors, and added up in several steps: the same trees."""
    monkeypatch.setattr(Trees, "growth", partialmethod(Trees.growth, rounds=3))
    pairs = q.pair_model(many)
    stats = q.statistics(many, pairs)
    models = [q._models(stats, pairs)]
    monkeypatch.setattr(q, "PART_ROWS", 1500)
    models.append(q._models(stats, pairs))
    monkeypatch.setattr(q, "PARTS", 1)
    models.append(q._models(stats, pairs))
    assert len(models[0][0].trees) == 3 and (models[0][0].trees[0][0] >= 0).any()
    assert str(models[0]) == str(models[1]) == str(models[2])


def test_quantiles_of_rows_in_parts():
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(size=5000), rng.integers(0, 3, 5000) / 3, np.zeros(5000), rng.choice([-0.0, 0.0, 1e-300, -1e300], 5000)], axis=1)
    shares = np.linspace(0, 1, 33)[1:-1]
    for rows in (1, 2, 7, 5000):
        search = ranks.Search(x.shape[1], ranks.quantile_ranks(rows, shares))
        for done in range(ranks.PASSES):
            known = search.prefixes()
            search.narrow(sum(ranks.count(part, known, done) for part in np.array_split(x[:rows], 3)))
        assert np.array_equal(ranks.quantiles(ranks.values(search.prefix), rows, shares).T, np.quantile(x[:rows], shares, axis=0))


def test_tables_with_nothing_to_judge(spark):
    """Null keys and rows without text or title: their rows come out, and the other model is fitted."""
    rows = [(None, "Vale Tower", None), (1, " ", ""), (1, None, None)]
    got = q.quality(spark.createDataFrame(rows, "doc_id long, title string, text string")).collect()
    assert len(got) == 3 and all(r.text_junk is None for r in got) and [r.doc_id for r in got if r.title_junk is not None] == [None]
