import test_jaccard_join
import test_line_dedup
import test_packing
import test_secret_scan
from pyspark.sql import functions as F

import corpus_pipeline as p
from marlstone.llm import line_dedup, secret_scan
from marlstone.llm.queries import op9_quality


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def masked(text):
    spans, out, at = test_secret_scan.brute(text), "", 0
    for _, a, b in spans:
        if a >= at:
            out += text[at:a] + secret_scan.MASK
        at = max(at, b)
    return out + text[at:]


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    good = p.quality(spark, docs, sf_dir)
    assert good.columns == columns
    assert sorted(rows(good)) == sorted(r.doc_id for r in op9_quality(spark, sf_dir).collect() if r.kept)

    good = good.withColumn("text", F.when(F.col("doc_id") % 50 != 7, F.col("text")))
    now = rows(good)
    unlike = p.near_copies(spark, good, sf_dir)
    groups = test_jaccard_join.brute([(i, r.text) for i, r in now.items()], 5, 8, 10)
    assert unlike.columns == columns
    after = rows(unlike)
    assert set(after) == {i for i, _, c in groups if i == c} and all(after[i] == now[i] for i in after)

    single = p.shared_passages(spark, unlike, sf_dir)
    runs, left = test_line_dedup.brute([(i, r.text) for i, r in after.items()], line_dedup.MIN_WORDS, line_dedup.LINE_WORDS)
    cut = {r[0] for r in runs}
    want = {i: (None if after[i].text is None else left[i]) for i in after if not (i in cut and not left[i].strip(" "))}
    assert single.columns == columns
    now = rows(single)
    assert {i: r.text for i, r in now.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in now.values())

    clean = p.secrets(spark, single, sf_dir)
    assert clean.columns == columns
    after = rows(clean)
    assert {i: r.text for i, r in after.items()} == {i: r.text and masked(r.text) for i, r in now.items()}

    packed = p.packed(spark, clean, sf_dir)
    assert test_packing.check(packed.collect(), {i: r.text for i, r in after.items()}, 2048) < 0.05


def test_run_over_the_whole_table_and_over_none(spark, sf_dir, tmp_path):
    got = p.run(spark, sf_dir)
    assert got.select("doc_id").distinct().count() > 0.4 * spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
