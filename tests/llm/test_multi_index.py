import random

import numpy as np
import pytest

from marlstone.llm import multi_index as m
from marlstone.llm.queries import op4_near_vectors


def brute(rows, least):
    good = [(i, np.array(v, "f8"), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(np.array(v, "f8")).all() and any(v)]
    up = {i: i for i, _, _ in rows}
    links = dict.fromkeys(up, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                r, s = sorted((root(i), root(j)))
                up[s] = r
    return sorted((i, links[i], root(i), i == root(i)) for i in up)


def corpus(n=400, d=16):
    r = np.random.default_rng(5)
    base = r.normal(size=(30, d))
    out = []
    for i in range(n):
        v = base[r.integers(30)] + r.normal(size=d) * r.choice([0, 0.05, 0.2, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(r.integers(3))))
    out += [(1000 + i, out[7][1], out[7][2]) for i in range(40)]
    out += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * d, 1), (2003, [1.0] * (d - 1) + [float("nan")], 1), (2004, [1.0] * (d - 1) + [None], 1), (2005, [float("inf")] * d, 1), (2006, [1.0] * d, None), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [1.0], 1), (2010, [5.0], 1), (2011, [1e30] * d, 2), (2012, [2e30] * d, 2)]
    return out


@pytest.mark.parametrize("least,block", [(0.98, 4096), (0.9, 16)])
def test_equals_all_pairs(spark, least, block):
    rows = corpus()
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, times int").repartition(3)
    assert sorted(tuple(r) for r in m.near_duplicates(df, least, block=block).collect()) == brute(rows, least)


def test_bounds_never_pass_the_distance():
    r = np.random.default_rng(2)
    x, c = r.normal(size=(300, 8)), r.normal(size=(12, 8))
    near, low = m.bounds(x, c)
    true = ((x[:, None] - x[None]) ** 2).sum(2)
    for j in range(300):
        assert (low[:, near[j]] <= true[:, j] + 1e-9).all()


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in m.near_duplicates(df).collect()), key=str) == [(3, 1, 3, True), (3, 1, 3, True), (None, 0, None, False)]
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in op4_near_vectors(spark, sf_dir).collect()) == brute(rows, 0.98)
