import random
import re

import numpy as np
import pytest

from marlstone.llm import jaccard_join as j
from marlstone.llm.components import connected_components
from marlstone.llm.queries import op10_jaccard_join


def shingles(text, n):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    m = min(n, len(words))
    return frozenset(tuple(words[i : i + m]) for i in range(len(words) - m + 1))


def brute(rows, n, num, den):
    """{id: (sizes, component)} by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                r, s = sorted((root(sets[a][0]), root(sets[b][0])))
                up[s] = r
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, docs=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out, bases = [], []
    for i in range(docs):
        kind = r.random()
        if bases and kind < 0.5:
            words = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words = words[: max(1, len(words) - r.randrange(4))]
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 8, 20, 40, 90, 300]))]
            if r.random() < 0.4:
                words += passage
            bases.append(words)
        out.append((i, " ".join(words)))
    return out


ODD = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "one"), (1006, "ONE"), (1007, "É x y z"), (1008, "é x y z"), (1009, "a b " * 4000), (1010, "a b " * 4001)]


@pytest.mark.parametrize("n,num,den,block", [(3, 9, 10, 10**6), (5, 8, 10, 600), (2, 5, 10, 300)])
def test_equals_all_pairs(spark, n, num, den, block):
    rows = corpus(n) + ODD
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, key string, size int").repartition(3)
    got = sorted(tuple(r) for r in j.join(df, n, num, den, tree_grams=block, group=max(2, block // 100)).collect())
    assert got == brute(rows, n, num, den)


def test_bitmaps_rule_out_no_link():
    r = random.Random(8)
    rows = [t for _, t in corpus(9, 120)]
    for n, num, den in ((3, 9, 10), (5, 8, 10)):
        sets = [(shingles(t, n), j.gram_set(t, n, {})) for t in rows]
        for (x, gx), (y, gy) in (r.sample(sets, 2) for _ in range(3000)):
            assert len(x) == len(gx)
            if den * len(x & y) >= num * len(x | y):
                assert j.may_link(len(gx), j.parity(gx), len(gy), j.parity(gy), num, den)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text + " z")], "doc_id long, text string")
    got = sorted((tuple(r) for r in j.join(df, 3, 9, 10).collect()), key=str)
    assert got == sorted([(5, 28, 5), (5, 28, 5), (None, 28, None), (9, 29, 5)], key=str)
    assert j.join(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op10_jaccard_join(spark, sf_dir).collect()) == brute(rows, 3, 9, 10)


@pytest.mark.parametrize("num,den", [(8, 10), (9, 10)])
def test_sets_with_nothing_in_common_share_no_part(num, den):
    r = np.random.default_rng(5)
    starts, seen, keys, sets = j.size_classes(num, den, j.MOST), set(), 0, 0
    for size in [*range(1, 60), 100, 400, 1500] * 12:
        own = set(j.part_keys(np.unique(r.integers(0, 2**64, size, np.uint64)), num, den, starts).tolist())
        assert not own & seen
        seen |= own
        keys, sets = keys + len(own), sets + size
    assert keys < 0.75 * sets


def test_linked_sets_share_a_part():
    r = np.random.default_rng(6)
    for num, den in ((8, 10), (9, 10), (5, 10)):
        starts = j.size_classes(num, den, j.MOST)
        for _ in range(400):
            a = np.unique(r.integers(0, 2**64, r.integers(2, 120), np.uint64))
            keep, more = r.random(len(a)) > r.random() * 0.3, r.integers(0, 2**64, r.integers(0, 1 + len(a) // 3), np.uint64)
            b = np.unique(np.concatenate([a[keep], more]))
            both = len(np.intersect1d(a, b))
            if 0 < both < len(np.union1d(a, b)) and den * both >= num * len(np.union1d(a, b)):
                assert set(j.part_keys(a, num, den, starts).tolist()) & set(j.part_keys(b, num, den, starts).tolist())
