import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import ordinal as o
from marlstone.llm.queries import op9_quality


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = os.environ.get("TEST_LARGE_SF_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.1"))
    docs, rated = spark.read.parquet(f"{sf_dir}/documents.parquet"), o.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = o.fit(docs, rated.where("doc_id % 4 <> 0"), o.GRADES)
    held = o.score(docs.select("doc_id", "text"), model, o.GOOD).join(rated.where("doc_id % 4 = 0"), "doc_id").toPandas()
    good, tail = held.grade == 2, held["tail"] >= 0.5
    assert (tail & good).sum() / good.sum() > 0.98
    assert (~tail & ~good).sum() / (~good).sum() > 0.8
    means = held.groupby("grade").expected_grade.mean()
    assert means[0] < means[2] and means[1] < means[2]


def test_thresholds_are_ordered_and_recover_grades(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        g = r.randrange(4)
        rows.append((i, " ".join(r.choice(["low", "mid", "high", "top"][g : g + 1] * 2 + [f"x{r.randrange(30)}"]) for _ in range(12)), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = o.fit(df, df.select("doc_id", "grade"), 4)
    assert list(model.thresholds) == sorted(model.thresholds) and model.n_rated == 600
    got = o.score(df, model, 2).toPandas()
    assert (abs(got.expected_grade - got.grade) < 0.5).mean() > 0.9
    assert ((got["tail"] >= 0.5) == (got.grade >= 2)).mean() > 0.95


def test_gradient_of_the_likelihood_stops_at_the_optimum(spark):
    df = spark.createDataFrame([(1, "a b", 0), (2, "a c", 1), (3, "a b", 1), (4, "", 2), (5, None, 2)], "doc_id long, text string, grade int")
    model = o.fit(df, df, 3)
    assert np.isfinite(model.weights).all() and model.thresholds[0] < model.thresholds[1]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 2.0), (1, None, "x", 2.0), (None, "", "y", 3.0), (3, "word " * 30000, "z", 4.0)], "doc_id long, text string, `odd name` string, tail double")
    ratings = spark.createDataFrame([(1, None), (None, 1), (9, 1), (3, 7)], "doc_id long, grade int")
    model = o.fit(df, ratings, 3)
    assert model.n_rated == 0
    got = o.score(df, model, 2).collect()
    assert len(got) == 4 and got[0].__fields__ == ["doc_id", "text", "odd name", "expected_grade", "tail"]
    assert all(abs(r.tail - 1 / 3) < 1e-9 and abs(r.expected_grade - 1) < 1e-9 for r in got)
    assert o.score(df.limit(0), model, 2).count() == 0


def test_query_keeps_most_good_documents(spark, sf_dir):
    got = op9_quality(spark, sf_dir)
    both = got.join(o.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id").where("grade = 2")
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert both.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.9


def plain_fit(rows, grades, rounds, l2):
    """The same regression by loops over dicts: rows of (grade, text), Adam on the whole sample's mean loss."""
    n = len(rows)
    made = []
    for g, text in rows:
        shape, words = o.shape_and_words(text)
        made.append((g, {**dict(enumerate(shape)), **{o.slot(w): 1.0 for w in words}}))
    held = {}
    for _, x in made:
        for k in x:
            held[k] = held.get(k, 0) + 1
    names = [*range(o.SHAPE), *sorted(k for k in held if k >= o.SHAPE and held[k] >= max(3, n // o.RARE))]
    share = [min(max(sum(g <= k for g, _ in made) / n, 1e-3), 1 - 1e-3) for k in range(grades - 1)]
    logit = [math.log(p / (1 - p)) for p in share]
    p = {k: 0.0 for k in names} | {"first": logit[0]} | {("gap", k): math.log(max(logit[k + 1] - logit[k], 0.05)) for k in range(grades - 2)}
    m, s = dict.fromkeys(p, 0.0), dict.fromkeys(p, 0.0)
    cuts_of = lambda p: [p["first"] + sum(math.exp(p["gap", j]) for j in range(k)) for k in range(grades - 1)]
    sigmoid = lambda x: 1 / (1 + math.exp(-min(max(x, -40), 40)))
    for step in range(1, rounds + 1):
        grad = {k: l2 * p[k] if isinstance(k, int) else 0.0 for k in p}
        cuts = cuts_of(p)
        for g, x in made:
            z = sum(p[k] * v for k, v in x.items() if k in p)
            lo = sigmoid(cuts[g - 1] - z) if g else 0.0
            hi = sigmoid(cuts[g] - z) if g < grades - 1 else 1.0
            mass = max(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / mass / n, lo * (1 - lo) / mass / n
            for k, v in x.items():
                if k in p:
                    grad[k] += (d_hi - d_lo) * v
            for k, d in ((g, -d_hi), (g - 1, d_lo)):
                if 0 <= k < grades - 1:
                    grad["first"] += d
                    for j in range(k):
                        grad["gap", j] += d * math.exp(p["gap", j])
        rate = 0.05 * min(1.0, 3 * (1 - (step - 1) / rounds))
        for k, d in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.99 * s[k] + 0.01 * d * d
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (math.sqrt(s[k] / (1 - 0.99**step)) + 1e-9)
    return {k: v for k, v in p.items() if isinstance(k, int)}, cuts_of(p)


def test_fit_and_scores_equal_a_plain_version(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(r.choice(words[g * 6 :]) for _ in range(r.randrange(1, 30))).title() + "!! " * g, g) for i in range(90) for g in [r.randrange(4)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int").repartition(3)
    model = o.fit(df, df, 4, rounds=40)
    weights, cuts = plain_fit([(g, t) for _, t, g in rows], 4, 40, 2e-4)
    assert np.allclose(model.thresholds, cuts, atol=1e-6)
    assert all(abs(model.weights[k] - v) < 1e-6 for k, v in weights.items()) and np.count_nonzero(model.weights) <= len(weights)
    for row in o.score(df, model, 2).collect():
        shape, found = o.shape_and_words(row.text)
        z = sum(weights.get(k, 0) * v for k, v in enumerate(shape)) + sum(weights.get(x, 0) for x in map(o.slot, found))
        tails = [1 / (1 + math.exp(c - z)) for c in cuts]
        assert abs(row.expected_grade - sum(tails)) < 1e-5 and abs(row.tail - tails[1]) < 1e-5


def test_sample_is_bounded_where_an_id_repeats(spark):
    df = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int")
    assert o.fit(df, ratings, 2, sample=20, rounds=2).n_rated == 20
