"""The curve, recall against brute force, and vectors that repeat or take no part."""

import math

import numpy as np
from pyspark.sql import functions as F

from evidence.llm import neighbours as N
from evidence.llm.queries import op5_neighbours

SHAPE = "vec_id bigint, embedding array<float>, query_id string, cls string, ids string"


def brute(rows, query_ids, k=10):
    """Every query against every other usable row; rows is {(vec_id, vector tuple)}."""
    out = {}
    for q, v in rows:
        if q in query_ids:
            a = np.array(v, np.float32).astype(float)
            found = sorted((float(np.sqrt(((a - np.array(w, np.float32).astype(float)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = found[:k]
    return out


def test_curve_visits_every_cell_by_single_steps():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * d)).reshape(d, -1).T
        place = N.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        way = cells[np.argsort(place)]
        assert (np.abs(np.diff(way, axis=0)).sum(axis=1) == 1).all()


def test_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, tuple(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    got: dict[int, list] = {}
    for r in sorted(op5_neighbours(spark, folder).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    by_id = dict(rows)
    for q, found in got.items():
        assert found == sorted(found)
        a = np.array(by_id[q], float)
        assert all(abs(s - math.dist(a, by_id[i])) < 1e-12 for s, i in found)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(40)] + [(40, [1.0, 0.0, 0.6]), (41, [1.0, 0.1, 0.5]), (50, [3.0, 3.0, 3.0]), (50, [3.0, 3.0, 3.0])]
    bad = [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [1.0, math.nan, 2.0]), (64, [1.0, math.inf, 2.0]), (65, [1.0]), (66, []), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows + bad], SHAPE)
    got: dict[int, list] = {}
    for r in sorted(N.nearest(df, F.col("vec_id") % 10 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.score, r.vec_id))
    want = brute(sorted(set((i, tuple(v)) for i, v in rows)), {0, 10, 20, 30, 40, 50})
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id bigint, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in N.nearest(df, F.col("vec_id") == 0).collect()] == [(1, 1, 1.0), (2, 2, 3.0)]
    assert N.nearest(df, F.col("vec_id") == 9).count() == 0
    assert N.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert N.nearest(df.limit(1), F.col("vec_id") >= 0).count() == 0


def test_many_equal_distances():
    x = np.concatenate([np.eye(40), -np.eye(40)])
    rows, near, away = N.closest(x, np.zeros((1, 40)), np.arange(80)[::-1].copy(), np.array([-1]), np.arange(80), 10)
    assert near.tolist() == list(range(79, 69, -1)) and set(away) == {1.0} and set(rows) == {0}
