"""The inverted file of vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import neighbours as N
from feedloom.operators import similar as R

KIND = "item_id long, embedding array<float>"


@pytest.fixture(scope="module")
def grouped(spark):
    """2,000 vectors about 40 directions, and one vector 300 times, whose list is then a hot one."""
    rng = np.random.default_rng(4)
    about = rng.standard_normal((40, 32))
    v = about[rng.integers(0, 40, 2000)] + 0.35 * rng.standard_normal((2000, 32))
    v = np.vstack([v, np.repeat(about[:1], 300, 0)])
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], KIND).repartition(4).cache()


def pairs(df):
    return {(r.source_id, r.item_id) for r in df.select("source_id", "item_id").collect()}


def brute(grouped, ids, least, limit):
    rows = grouped.orderBy("item_id").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = set()
    for i in ids:
        d = 1 - v @ v[i]
        d[i] = 9
        out |= {(i, int(j)) for j in sorted(np.flatnonzero(d <= 1 - least), key=lambda j: (d[j], j))[:limit]}
    return out


@pytest.mark.parametrize("piece", [1 << 16, 500])
def test_exact_search(spark, grouped, piece):
    asked = grouped.where("item_id % 50 = 0").withColumnRenamed("item_id", "source_id")
    got = N.exact(asked, grouped, 0.6, 25, piece)
    want = brute(grouped, range(0, 2300, 50), 0.6, 25)
    ties = {s for s, _ in pairs(got) ^ want}  # copies of one vector differ in the last bits
    assert ties <= {s for s, j in want if j >= 2000}
    assert len(pairs(got)) == len(want)


@pytest.mark.parametrize("piece", [1 << 16, 50])
def test_index_finds_most_and_scores_few(grouped, piece):
    asked = grouped.where("item_id % 20 = 0 and item_id < 2000").withColumnRenamed("item_id", "source_id")
    index = N.index_of(grouped, lists=40)
    found = N.candidates(index, asked, 0.6, 200, 3, piece)
    near = N.reranked(found, asked, grouped, 0.6, 150)
    want = N.exact(asked, grouped, 0.6, 150)
    figures = N.work(index, asked, 3).first()
    assert R.recall(want, near).first().recall >= 0.9
    assert figures.pairs == 100 * 2300 and figures.scanned <= 0.25 * figures.pairs and found.count() <= 0.1 * figures.pairs
    assert all(abs(a.distance - b.distance) < 1e-9 for a, b in zip(want.where("source_id = 40").orderBy("place").limit(20).collect(), near.where("source_id = 40").orderBy("place").limit(20).collect(), strict=True))


def test_all_items_as_sources(grouped):
    index = N.index_of(grouped)
    asked = grouped.withColumnRenamed("item_id", "source_id")
    assert N.reranked(N.candidates(index, asked, 0.6, 50, 8), asked, grouped, 0.6, 20).select("source_id").distinct().count() > 2200


def test_saved_index_and_additions(spark, grouped, tmp_path):
    path = str(tmp_path / "index")
    N.index_of(grouped.where("item_id % 2 = 0"), lists=30).save(path)
    N.Index.load(spark, path).add(grouped.where("item_id % 2 = 1"), path)
    index = N.Index.load(spark, path)
    assert index.rows.count() == 2300
    asked = grouped.where("item_id % 100 = 1 and item_id < 2000").withColumnRenamed("item_id", "source_id")
    near = N.reranked(N.candidates(index, asked, 0.6, 200, 6), asked, grouped, 0.6, 150)
    assert R.recall(N.exact(asked, grouped, 0.6, 150), near).first().recall >= 0.9


def test_nothing_stored_or_asked(spark, grouped):
    none = grouped.where("false")
    asked = grouped.where("item_id < 3").withColumnRenamed("item_id", "source_id")
    assert N.candidates(N.index_of(grouped), asked.where("false"), 0.5, 10, 3).count() == 0
    assert N.exact(asked, none, 0.5, 10).count() == 0
    empty = N.index_of(none)
    assert empty.rows.count() == 0 and N.work(empty, asked.where("false"), 3).first().pairs == 0


def test_codes_keep_the_order_of_many_vectors():
    """Of 9,000 vectors spread evenly the best 150 are among the first 300 by their codes."""
    import numpy as np

    from feedloom.operators.neighbours import Quantiser, unit

    v = unit(np.random.default_rng(4).normal(size=(9000, 64)))
    q = Quantiser.fitted(v, 8)
    near, coded = v[:60] @ v.T, v[:60] @ q.decoded(*q.coded(v)).T
    first = lambda x, n: np.argsort(-x, axis=1)[:, :n]
    assert np.mean([np.isin(a, b).mean() for a, b in zip(first(near, 151), first(coded, 300), strict=True)]) > 0.95


@pytest.mark.parametrize("hits", [1 << 21, 50])
def test_a_source_costs_rows_by_its_parts_alone(spark, grouped, monkeypatch, hits):
    """However many lists and vectors are near a source, each part gives its nearest, and groups of sources get the same."""
    monkeypatch.setattr(N, "HITS", hits)
    asked = grouped.where("item_id % 20 = 0 and item_id < 2000").withColumnRenamed("item_id", "source_id")
    index = N.index_of(grouped, lists=40)
    near = []
    monkeypatch.setattr(N, "first_of_each", lambda df, limit, of=N.first_of_each: near.append(df.count()) or of(df, limit))
    found = pairs(N.candidates(index, asked, -0.9, 10, 40, 100))
    want = pairs(N.exact(asked, grouped, -0.9, 10, 100))
    assert max(near) <= 100 * 10 * N.PARTS and len(found) == len(want) == 100 * 10
    monkeypatch.setattr(N, "GROUP", 30)
    assert pairs(N.candidates(index, asked, -0.9, 10, 40, 100)) == found
    few = {s for s, _ in pairs(N.exact(asked, grouped, -0.9, 10, 100)) ^ want}  # copies of one vector differ in the last bits
    assert len(few) <= 10
