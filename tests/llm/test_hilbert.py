import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import hilbert as h
from marlstone.llm.queries import op8_hilbert_search


def brute(rows, is_query, k):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(np.array(v, "f8")).all() and any(v):
            good[i] = np.array(v, "f8")
    out = []
    for i, q in good.items():
        if is_query(i):
            near = sorted((-float(h.exact_scores(x[None], q)[0]), j) for j, x in good.items() if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def test_the_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = h.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def corpus(n=500, d=12):
    r = np.random.default_rng(4)
    base = r.normal(size=(25, d))
    rows = [(i, [float(np.float32(x)) for x in base[r.integers(25)] * r.uniform(0.5, 2) + r.normal(size=d) * 0.2]) for i in range(n)]
    rows += [(1000 + i, rows[10][1]) for i in range(60)]
    return rows + [(2000, None), (2020, []), (2040, [0.0] * d), (2060, [float("nan")] * d), (2080, [None] * d), (None, [1.0] * d)]


@pytest.mark.parametrize("window,piece", [(256, 8192), (8, 50)])
def test_equals_all_pairs(spark, window, piece):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double").repartition(3)
    got = h.search(df, F.col("vec_id") % 20 == 0, k=7, window=window, piece=piece)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 20 == 0, 7)


def test_windows_alone_find_most_of_clustered_neighbours(spark):
    rows = corpus()[:560]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in h.search(df, F.col("vec_id") % 20 == 0, k=7, window=60, complete=False).collect()}
    want = {(i, j) for i, _, j, _ in brute(rows, lambda i: i % 20 == 0, 7)}
    assert len(got & want) / len(want) > 0.7


def test_repeated_ids_and_several_widths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [3.0, 2.0, 1.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for complete in (True, False):
        got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in h.search(df, F.col("vec_id") != 2, k=5, complete=complete).collect())
        assert got == sorted([(1, 1, 1, 0.9), (1, 2, 1, 0.1), (1, 3, 2, 0.0), (1, 1, 1, 0.9), (1, 2, 1, 0.11), (1, 3, 2, 0.1), (1, 1, 2, 0.2), (1, 2, 1, 0.11), (1, 3, 1, 0.1), (3, 1, 4, 10.0), (4, 1, 3, 10.0)])


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in h.search(df, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert h.search(df.limit(0), F.lit(True)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in op8_hilbert_search(spark, sf_dir).collect()) == brute(rows, lambda i: i % 20 == 0, 20)
