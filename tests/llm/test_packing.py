import random

import pandas as pd
import pytest

from loresift.llm.packing import packed

SCHEMA = "doc_id long, text string, source string, n_tokens int, shard int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(k, "x", rng.choice(["hot"] * 5 + ["a", "b", None, ""]), int(min(9000, rng.lognormvariate(5.5, 1.0)))) for k in range(3000)]
    return [*out, (5000, "One, two. naïve_x नमस्ते", "a", None), (5001, None, "a", None), (5002, "", None, None), (5003, "a b", "a", -4), (5004, "x", "a", 4096), (5005, "x", "b", 2048)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("shard_rows", [50_000, 400])
def test_packing(spark, rows, shard_rows):
    got = packed(frame(spark, rows), shard_rows=shard_rows).toPandas()
    assert set(got.doc_id) == {r[0] for r in rows}
    sizes = {r[0]: r[3] for r in rows} | {5000: len(["One", ",", "two", ".", "naïve_x", "नमस", "्", "त", "े"]), 5001: 0, 5002: 0, 5003: 2}
    assert got.groupby("doc_id").tokens.sum().to_dict() == sizes
    assert got.groupby("container_id").tokens.sum().max() <= 2048
    pieces = got.groupby("doc_id").piece_no.agg(["count", "max"])
    for doc, size in sizes.items():
        assert pieces.loc[doc, "count"] == max(1, -(-size // 2048)) == pieces.loc[doc, "max"] + 1
    least = -(-sum(sizes.values()) // 2048)
    assert got.container_id.nunique() <= least * (1.02 if shard_rows > 1000 else 1.06) + 1


def test_mixture_is_held_in_every_stretch(spark, rows):
    """Each tenth of the containers holds the sources in about the proportions of the whole."""
    own = [r for r in rows if r[0] < 3000 and r[3] <= 600]
    got = packed(frame(spark, own)).toPandas().merge(pd.DataFrame(own, columns=["doc_id", "t", "source", "n"]), on="doc_id")
    hot = got[got.source == "hot"].tokens.sum() / got.tokens.sum()
    part = pd.qcut(got.container_id.rank(method="dense"), 10, labels=False)
    for _, piece in list(got.groupby(part))[:9]:
        assert abs(piece[piece.source == "hot"].tokens.sum() / piece.tokens.sum() - hot) < 0.1


def test_targets_and_empty(spark, rows):
    assert packed(frame(spark, rows), targets={"a": 5.0}).count() >= len(rows)
    assert packed(frame(spark, rows).limit(0)).count() == 0
    assert packed(frame(spark, [(1, None, None, None)])).count() == 1
