"""Term search in pieces against scoring every item."""

import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.operators.similar import lexical_candidates

WORDS = [f"w{k}" for k in range(30)]


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    text = lambda n: None if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randrange(n)))
    rows = [(i, text(4), text(6), text(40), None if i % 5 == 0 else i % 9) for i in range(150)]
    return rows + [(i, *rows[1][1:]) for i in range(150, 260)]  # a large group of copies, all of one rank and time


def brute(items, limit):
    out = {}
    for s, title, summary, _, _ in items:
        if s % 10:
            continue
        terms = set(list(dict.fromkeys(f"{title or ''} {summary or ''}".split()))[:16])
        best = []
        for i, *texts, at in items:
            total = sum(w * sum(x in terms for x in (t or "").split()) for t, w in zip(texts, (10, 4, 1), strict=True))
            if total and i != s:
                best.append((-round(total / (total + 10), 9), at is None, -(at or 0), -i))
        out |= {(s, -r[-1]): (k + 1, -r[0]) for k, r in enumerate(sorted(best)[:limit])}
    return out


@pytest.mark.parametrize(("limit", "piece"), [(5, 300), (20, 1 << 20), (150, 3000)])
def test_pieces_give_the_best_of_all(spark, items, limit, piece):
    rows = spark.createDataFrame(items, "id long, title string, summary_text string, content string, at long").withColumn("published_at", F.timestamp_seconds("at"))
    sources = rows.where("id % 10 = 0").select(F.col("id").alias("source_id"))
    got = {(r.source_id, r.item_id): (r.place, r["rank"]) for r in lexical_candidates(sources, rows, limit, piece=piece).collect()}
    assert got == brute(items, limit)


def test_hits_are_never_rows(spark, items):
    """No join or sum of (search, item) rows: a word that all items have costs each search one array."""
    rows = spark.createDataFrame(items, "id long, title string, summary_text string, content string, at long").withColumn("published_at", F.timestamp_seconds("at"))
    plan = lexical_candidates(rows.select(F.col("id").alias("source_id")), rows)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[source_id#\d+L?, item_id", plan)
    assert plan.count("Join") == 1  # sources with their own texts
