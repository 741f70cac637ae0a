"""Approximate nearest neighbours: exact where all lists are visited, recall against brute force, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from standmill.llm import ann_search

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=20, every=20):
    """All queries against all rows."""
    rows = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and not any(x is None for x in v)]
    rows = [(i, v) for i, v in rows if len(v) and np.isfinite(v).all() and v.any()]
    found = []
    for at, (q, v) in enumerate(rows):
        if q % every == 0:
            others = sorted((-float((w * v).sum()), i) for k2, (i, w) in enumerate(rows) if k2 != at and len(w) == len(v))[:k]
            found += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(others)]
    return sorted(found)


def given(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


def recall(found, wanted):
    want = {(q, i) for q, _, i, _ in wanted}
    return len(want & {(q, i) for q, _, i, _ in found}) / len(want)


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    wanted = plain([(r.vec_id, r.embedding) for r in table.collect()])
    found = given(ann_search.nearest(table, F.col("vec_id") % 20 == 0))
    assert len(found) == len(wanted) and recall(found, wanted) >= 0.9


@pytest.mark.parametrize("kind", ["even", "grouped", "lengths"])
def test_recall_and_work_on_many_lists(spark, monkeypatch, kind):
    monkeypatch.setattr(ann_search, "LIST_ROWS", 64)
    monkeypatch.setattr(ann_search, "PART_ROWS", 100)
    monkeypatch.setattr(ann_search, "QUERY_ROWS", 16)
    r = np.random.default_rng(3)
    v = r.normal(size=(3000, 24))
    if kind == "grouped":
        v = r.normal(size=(40, 24))[r.integers(0, 40, 3000)] + 0.1 * v
    if kind == "lengths":
        v *= r.uniform(0.5, 2, (3000, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    wanted, found = plain(rows), given(ann_search.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert len(found) == len(wanted) and recall(found, wanted) >= 0.9
    exact = {(q, i): s for q, _, i, s in plain(rows, k=3000)}
    assert all(exact[q, i] == s for q, _, i, s in found)


def test_lists_are_balanced_and_grouped_vectors_visit_few(monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(40, 24))[r.integers(0, 40, 4000)] + 0.05 * r.normal(size=(4000, 24))
    index = ann_search.Index(None, float(np.sqrt((v**2).sum(axis=1)).max()))
    placed = index.placed(v)
    index.graph = ann_search.CentreGraph(ann_search.balanced_centres(placed, 64))
    row, centre = index.graph.search(placed, 1.0, 1)
    assert len(row) == 4000 and np.bincount(centre, minlength=64).max() < 8 * 4000 / 64
    gap = ((placed[:, None] - index.graph.centres) ** 2).sum(axis=2)
    assert (gap.argmin(axis=1) == centre).mean() > 0.98  # the graph finds the nearest centre
    assert len(index.graph.search(index.asked(v), ann_search.QUERY_RATIO)[0]) < 4000 * 64 / 4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (20, [1.0, 0.0]), (40, [-0.0, 1.0]), (41, [0.0, 1.0]), (60, None), (80, [0.0, 0.0]), (100, [nan, 1.0]), (None, [1.0, 1.0]),
            (120, [inf, 1.0]), (140, [None, 1.0]), (160, []), (180, [1.0, 2.0, 3.0]), (200, [3.0, 1.0, -1.0]), (220, [5.0]), (7, [4.0, 4.0])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("uid", "v", "list", "ids", "n", "score")})
    assert given(ann_search.nearest(table, F.col("vec_id") % 20 == 0)) == plain(rows)
    assert ann_search.nearest(table.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


def test_floods_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(400 + i, [2.0, 1.0]) for i in range(50)] + [(460, [9.0, 9.0])]
    assert given(ann_search.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)) == plain(rows)
