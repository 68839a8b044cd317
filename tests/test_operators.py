import itertools
import math
import random
from fractions import Fraction
import sqlite3
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as t
from marlstone.functions.time import close_day, grain
from marlstone.operators import charts, grounding, keys, profile, results, retrieve, stats, values
from marlstone.sources import catalog, files
from marlstone.streaming.counts import run_once, session_counts, windowed_counts


def test_profile_of_nulls_and_of_types_that_can_not_be_grouped(spark):
    df = spark.sql("select * from values (1, 'a', map('k', 1)), (1, null, map('k', 2)), (null, 'b', null) t(x, y, m)")
    got = {r["column"]: r for r in profile.profile(df, "t").collect()}
    assert (got["x"].row_count, got["x"].distinct_count, got["x"].null_count) == (3, 1, 1)
    assert got["m"].measurement == "UNSUPPORTED" and got["m"].row_count is None
    unique = {r["column"]: r.is_unique for r in profile.key_facts(profile.profile(df, "t")).collect()}
    assert unique == {"x": False, "y": True, "m": None}


def test_profile_of_more_columns_than_one_job_takes(spark):
    df = spark.range(5).select(*(F.col("id").alias(f"c{i}") for i in range(20)))
    assert {r.distinct_count for r in profile.profile(df, "t").collect()} == {5}
    with pytest.raises(profile.TooLarge):
        profile.refuse_large(df, "t", 4)


def test_current_rows_of_a_history_are_unique(spark):
    rows = [(1, 0, "2019-01-01", "gold"), (1, 0, "2020-01-01", "silver"), (1, 1, None, "gold"), (2, 1, None, "bronze")]
    df = spark.createDataFrame(rows, "customer_id int, is_current int, valid_to string, tier string").withColumn("valid_to", F.to_date("valid_to"))
    got = {(r["column"], r.label): set(r.unique_columns) for r in profile.partition_uniqueness(df, "d", profile.profile(df, "d")).collect()}
    assert "customer_id" in got["is_current", "=1"] and "customer_id" not in got["is_current", "=0"] and "customer_id" in got["valid_to", "IS NULL"]


def test_labels_of_large_numbers_stay_apart(spark):
    df = spark.createDataFrame([(1, 2**53), (1, 2**53 + 1), (2, 2**53), (2, 2**53 + 1)], "k int, batch long")
    got = {r.label for r in profile.partition_uniqueness(df, "d", profile.profile(df, "d")).where("column = 'batch'").collect()}
    assert got == {"=9007199254740992", "=9007199254740993"}


def test_codes_are_grounded_by_one_label_only(spark):
    one = spark.createDataFrame([("A", "Active", "x"), ("A", "Active", "y"), ("B", "Blocked", None), (None, "?", "z")], "status string, status_name string, memo string")
    assert {tuple(r) for r in grounding.correlated(one, "status").collect()} == {("A", "Active"), ("B", "Blocked")}
    assert grounding.correlated(one.withColumn("status_label", F.col("status_name")), "status").count() == 0
    assert not profile.is_functional(one.limit(0), "status", "status_name").first().holds


def test_relationships_inferred_from_names_and_data(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "parent_id int, name string")
    child = spark.createDataFrame([(1, "1"), (2, " 2"), (3, None)], "child_id int, parent_id string")
    assert keys.infer({"parent": parent, "child": child}) == [("child", "parent_id", "parent", "parent_id")]
    assert keys.infer({"parent": parent, "child": child.union(spark.createDataFrame([(4, "9")], child.schema))}) == []
    assert keys.infer({"parent": parent.union(parent), "child": child}) == []
    assert keys.align_types([("a", "b"), ("b", "c"), ("x", "y")], {"a": "int", "b": "string", "c": "int", "x": "int", "y": "date"}, {("b", "int"): True}) == {"a": "int", "b": "int", "c": "int"}
    merged = keys.merge(spark.createDataFrame([("c", "p", "x=x")], "child string, parent string, join_keys string"), spark.createDataFrame([("c", "q", "y=y"), ("d", "p", "x=x")], "child string, parent string, join_keys string"))
    assert sorted(tuple(r) for r in merged.collect()) == [("c", "p", "x=x"), ("d", "p", "x=x")]


def test_asof_join_against_brute_force(spark):
    r = random.Random(1)
    left = [(i, r.randrange(4), r.choice([None, r.randrange(50)])) for i in range(80)]
    right = [(r.randrange(4), r.randrange(50), r.randrange(1000)) for _ in range(120)]
    got = keys.asof_join(spark.createDataFrame(left, "i int, k int, at int"), spark.createDataFrame(right, "k int, at int, v int"), "at", ["k"], ["v"]).collect()
    for row in got:
        fit = [(a, v) for k, a, v in right if k == row.k and row.at is not None and a <= row.at]
        assert row.right_v == (max(fit)[1] if fit else None)
    assert len(got) == len(left)


def test_value_index_leaves_out_keys_and_personal_columns(spark):
    df = spark.createDataFrame([("EU", "1", "Bob"), ("US", "2", "Eve"), (None, "3", "Ann")], "region string, country_id string, name string")
    tables = {"country": df}
    index = values.build_index(tables, values.indexed_columns(tables, profile.profile(df, "country")))
    assert {tuple(r) for r in index.collect()} == {("country", "region", "EU"), ("country", "region", "US")}
    assert values.holds(df, "region", "EU") and not values.holds(df, "region", "XX")


def test_scheme_binding_gates(spark):
    held = spark.createDataFrame([("colour_cd", v) for v in ("R", "g", " B ", "K", "n/a")] + [("other", v) for v in "RGBK"], "column string, value string")
    schemes = spark.createDataFrame([("c", "Colour Codes", n) for n in "RGBKW"] + [("x", "Unrelated", n) for n in "RGBK"], "scheme_id string, label string, notation string")
    scores = grounding.scheme_scores(held, schemes)
    assert [tuple(r) for r in grounding.bind(scores).collect()] == [("colour_cd", "c")]
    assert "colour_cd" not in {r["column"] for r in grounding.suggestions(scores).collect()}


def test_trigrams_equal_python(spark):
    grams = lambda s: {f"  {s.lower()} "[i : i + 3] for i in range(len(s) + 1)}
    words = ["", "a", "Origin", "Sample Origin", "éa", "aaaa"]
    for a in words:
        for b in words:
            x, y = grams(a), grams(b)
            r = spark.range(1).select(t.similarity(F.lit(a), F.lit(b)).alias("s"), t.overlap(F.lit(a), F.lit(b)).alias("o")).first()
            assert math.isclose(r.s, len(x & y) / len(x | y)) and math.isclose(r.o, len(x & y) / min(len(x), len(y)))


def test_days_and_grains(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-03-09 10:00:00'), (timestamp_ntz'2024-03-10 00:00:00'), (null) t(ts)")
    counts = {op: df.where(close_day(F.col("ts"), op, "2024-03-09")).count() for op in ("=", "<>", "<=", ">", "<", ">=", "is distinct from", "is not distinct from")}
    assert counts == {"=": 1, "<>": 1, "<=": 1, ">": 1, "<": 0, ">=": 2, "is distinct from": 2, "is not distinct from": 1}
    assert df.select(grain("week", "ts").alias("w")).where("w is not null").distinct().count() == 1
    with pytest.raises(ValueError):
        grain("century", "ts")


def test_results_as_multisets_against_brute_force(spark):
    r = random.Random(5)
    for _ in range(6):
        a = [(r.randrange(3), r.choice([None, "x", " x", "y"]), r.choice([1.0, 1.001, 2.5])) for _ in range(6)]
        b = [(k, (s or "").strip() or None, v * (1 + r.choice([0, 1e-4, 0.1]))) for k, s, v in r.sample(a, len(a))]
        want = results.pairable([tuple(map(results.normal, x)) for x in a], [tuple(map(results.normal, x)) for x in b], results.agrees, results.Budget(10**6))
        kind = "k int, s string, v double"
        assert results.equal(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)) is want or not want
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    assert results.equal(one, one.select("b", "a")) and not results.equal(one, one.select("a")) and not results.equal(one, one.union(one))
    with pytest.raises(results.Undecided):
        results.equal(spark.range(50), spark.range(50, 100), most=20)


def test_rounding_and_facts():
    for a, b, want in ((7.35, 7.3467, True), (7.34, 7.345, True), (7.35, 7.345, True), (7.36, 7.345, False), (0.0, 0.3, False), (91.0, 90.71, True), (1.0, 0.71, False), (-2.0, -2.5, True), (-3.0, -2.5, True), (2.3, 2.25, True), (2.2, 2.25, True)):
        assert results.rounded_from(a, b) is want, (a, b)
    assert results.facts_equal([("a", 1.0)], [(7, 1.0, "a")]) and not results.facts_equal([("a", 1.0)], [("a", 2.0)]) and not results.facts_equal([("a",)], [])
    assert results.facts_equal([("a",), ("a",), ("b",)], [("b",), ("a",)], distinct=True) and not results.facts_equal([("a",), ("a",), ("b",)], [("b",), ("a",)])
    assert results.majority([[0, 2, 3], [1]]) == 0 and results.majority([[0], [1]]) is None
    assert results.best_of([[(1,)], [(2,)]], [(2,)], results.facts_equal) is True and results.best_of([[(1,)]], [(2,)], results.facts_equal) is False


def test_a_row_that_two_may_take_goes_to_the_one_that_needs_it():
    """Agreement within a tolerance: the first gold row may take either, the second only the first's."""
    got = [(0.3,), (0.250001,)]
    for gold in ([(0.25,), (0.34,)], [(0.34,), (0.25,)]):
        assert results.facts_equal(gold, got) and results.facts_equal(got, gold)
    r = random.Random(2)
    for _ in range(200):
        left, right = ([(r.randrange(8) / 2.0,) for _ in range(5)] for _ in range(2))
        near = lambda a, b: abs(a - b) <= 0.5
        want = any(all(near(a[0], b[0]) for a, b in zip(left, p)) for p in itertools.permutations(right))
        assert results.pairable(left, right, near, results.Budget(10**6)) is want
    with pytest.raises(results.Undecided):
        results.facts_equal([(float(i), 1.5) for i in range(50)], [(float(i), 1.5) for i in range(50)], steps=100)


def test_many_copies_of_one_row_stay_counts(spark):
    """A count of 10 ** 9 is compared as a count."""
    from unittest import mock

    one = spark.createDataFrame([(1.0, 10**9, 0)], "v double, left_n long, right_n long")
    counted = one.select(F.struct(F.col("v").alias("number"), F.lit(None).cast("string").alias("text")).alias("c0"), "left_n", "right_n")
    with mock.patch.object(results, "diff", lambda a, b: counted):
        assert not results.equal(one, one)
        other = counted.unionByName(counted.select(F.struct((F.col("c0.number") * 1.001).alias("number"), F.col("c0.text").alias("text")).alias("c0"), F.col("right_n").alias("left_n"), F.col("left_n").alias("right_n")))
        with mock.patch.object(results, "diff", lambda a, b: other), pytest.raises(results.Undecided):
            results.equal(one, one)


def test_statistics(spark):
    assert stats.sign_tail(0, 0) == 1 and stats.sign_tail(5, 0) == Fraction(1, 32) and stats.sign_tail(0, 5) == 1
    for a, b in itertools.product(range(9), repeat=2):
        assert stats.sign_tail(a, b) == Fraction(sum(math.comb(a + b, k) for k in range(a, a + b + 1)), 2 ** (a + b))
    pairs = spark.createDataFrame([("x", 6, 0), ("y", 3, 3), ("z", 0, 0)], "name string, only_a long, only_b long")
    assert [(r.name, r.p) for r in stats.paired_test(pairs).orderBy("name").collect()] == [("x", 0.03125), ("y", 1.0), ("z", 1.0)]
    tests = spark.createDataFrame([("a", 0.011), ("b", 0.02), ("c", 0.9)], "name string, p double")
    assert [(r.name, round(r.adjusted, 9), r.passes) for r in stats.step_down(tests, 0.05).orderBy("rank").collect()] == [("a", 0.033, True), ("b", 0.04, True), ("c", 0.9, False)]
    for arms, alpha in itertools.product((1, 2, 3, 7), (0.05, 0.01, 0.25, 1.0)):
        want = next((k for k in range(1, 30) if Fraction(2, 2**k) < Fraction(alpha) / arms), None)
        assert stats.wins_needed(30, arms, alpha) == want and stats.wins_needed(want - 1, arms, alpha) is None
    with pytest.raises(ValueError):
        stats.paired_test(spark.createDataFrame([("x", -1, 0)], "name string, only_a long, only_b long"))


def test_selection_by_passes(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 40)
    r = random.Random(4)
    values = [r.choice([0.0, 1.5, r.gauss(0, 1), r.gauss(0, 1) * 1e9]) for _ in range(3000)] + [None, 7.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    kept = sorted(v for v in values if v is not None)
    for place in (0, 1, 700, 1499, 2600, len(kept) - 1):
        assert stats.value_at(df, place) == kept[place]
    assert stats.value_at(df, len(kept)) is None and stats.percentile_at(df.limit(0), 0.5) is None
    assert stats.percentile_at(df, 0.95) == kept[int(0.95 * len(kept))]


def test_service_levels_of_nothing(spark):
    r = stats.service_levels(spark.createDataFrame([], "deferred boolean, failed boolean, cached boolean, total_ms double")).first()
    assert (r.answers, r.deferral_rate, r.p95_ms) == (0, 0.0, 0.0)


def test_ranking(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple"), (3, None), (4, "apple"), (5, "plum")], "doc_id long, text string")
    assert [r.doc_id for r in retrieve.bm25(docs, "apple plum").orderBy("rank").collect()][0] == 5
    assert [r.doc_id for r in retrieve.bm25(docs, "apple", k=2).orderBy("rank").collect()] == [2, 4]
    with pytest.raises(Exception, match="not 2 wide"):
        retrieve.nearest(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>"), [1.0, 0.0]).collect()
    assert retrieve.visible(docs.withColumn("table", F.lit("a")), []).count() == 0
    ex = spark.createDataFrame([("q", ["a", "b"]), ("r", ["a"]), ("s", [])], "question string, tables array<string>")
    assert [r.question for r in retrieve.examples_visible(ex, ["a"]).collect()] == ["r"]


def test_charts(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert charts.aggregates(line, "sum(l_tax)") and charts.aggregates(line, "no_such") is None
    assert charts.columns_read(line, "sum(l_tax * l_quantity)") == {"l_tax", "l_quantity"}
    share = charts.Metric("s", "100 * avg(l_discount)", "lineitem", frozenset(), percent=True)
    for bad in (lambda: charts.measure(line, [share], []), lambda: charts.measure(line, [charts.Metric("n", "count(*)", "lineitem", frozenset())], ["l_tax"])):
        with pytest.raises(charts.Incompatible):
            bad()
    with pytest.raises(charts.NotCheckable):
        charts.compile_chart(line, charts.Chart("hologram", [], []))


def test_catalogue(spark, tmp_path, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    assert catalog.scoped(["orders", "order_line", "x"], ["ORDER*"]) == ["order_line", "orders"]
    with pytest.raises(catalog.TablesNotFound):
        catalog.scoped(["orders"], ["zz"])
    both = catalog.federated({"a": {"nation": nation}, "b": {"nation": nation.limit(3)}})
    catalog.register_federated(both)
    assert spark.sql("select count(*) as n from a__nation x join b__nation y using (n_nationkey)").first().n == 3
    snap = {"columns": catalog.introspect({"nation": nation})}
    catalog.save_snapshot(snap, str(tmp_path), "v1")
    catalog.save_snapshot({"columns": snap["columns"].limit(1)}, str(tmp_path), "v2")
    assert [catalog.load_snapshot(spark, str(tmp_path), ["columns"], v)["columns"].count() for v in ("v1", "v2")] == [3, 1]
    assert catalog.content_version({"a": [1, 2]}) == catalog.content_version({"a": [2, 1]}) != catalog.content_version({"a": [2]})
    merged = catalog.merge_snapshots({"x": snap, "y": snap})
    assert {r["table"] for r in merged["columns"].collect()} == {"x.nation", "y.nation"}
    cache, made = catalog.ResultCache(10**6), []
    for _ in range(2):
        assert cache.get(("k",), lambda: made.append(1) or nation).num_rows == 25
    assert len(made) == 1 and catalog.table_size(nation) == 25 and catalog.functions(spark).where("kind = 'system'").count() > 400


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,,id\n1,x,q,9\n2,,r,8\n")
    got = files.read_csv(spark, f"{tmp_path}/a.csv")
    assert got.dtypes == [("id", "string"), ("name", "string")] and got.count() == 2
    with sqlite3.connect(tmp_path / "d.db") as con:
        con.execute("create table t (a integer, b text, c real)")
        con.executemany("insert into t values (?, ?, ?)", [(1, "x", 0.5), (2, None, None)])
    assert sorted(tuple(r) for r in files.read_sqlite(spark, f"{tmp_path}/d.db", "t").collect())[0] == (1, "x", 0.5)
    files.export({"r": spark.range(10)}, f"{tmp_path}/out", max_records=4)
    files.append(spark.range(3), f"{tmp_path}/out/r")
    assert files.read_parquet(spark, f"{tmp_path}/out/r").count() == 13
    assert files.from_ipc(files.to_ipc(spark.range(3))).num_rows == 3


def test_a_query_is_stopped_in_time(spark):
    slow = F.udf(lambda x: time.sleep(3) or x, "long")
    began = time.time()
    with pytest.raises(files.QueryTimeout):
        files.bounded(spark, lambda: spark.range(0, 40, 1, 4).select(slow("id")).collect(), 4)
    assert time.time() - began < 25
    assert files.bounded(spark, lambda: spark.range(3).count(), 30) == 3
    assert files.fault(files.QueryTimeout()) == "cancelled"


def test_a_stream_counts_what_its_table_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(f"{tmp_path}/in")
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, query in (("w", lambda df: windowed_counts(df, "1 hour", late="90 days")), ("s", lambda df: session_counts(df, "6 hours", late="90 days"))):
        run_once(spark, f"{tmp_path}/in", f"{tmp_path}/out-{name}", f"{tmp_path}/cp-{name}", query)
        got, want = (Counter(tuple(r) for r in df.collect()) for df in (spark.read.parquet(f"{tmp_path}/out-{name}"), query(events)))
        assert sum((got - want).values()) == 0 and sum(got.values()) > 0.5 * sum(want.values())
