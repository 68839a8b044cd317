"""From raw documents to packed training sequences: every stage is written as Parquet and read again by the next.

1. quality classifier: documents that are more likely toxic or junk than good go;
2. n-gram Jaccard join: of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays;
3. substring dedup: passages and whole lines that an earlier document holds are cut out; documents of which nothing is left go;
4. secret scans: found secrets are masked;
5. packing: documents are tokenised and packed into sequences.

All but the last return the columns of ``documents``, ``n_chars`` following the text. A null text stays null until
packing, which takes it as empty.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import jaccard_join, line_dedup, ordinal, packing, secret_scan
from marlstone.llm.common import release_executors, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal.fit(docs, ordinal.ratings(table(spark, sf_dir, "labels")), ordinal.GRADES)
    return ordinal.score(docs, model, ordinal.GOOD).where("tail >= 0.5").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.join(docs, n=5, num=8, den=10)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.remove(docs, line_dedup.repeats(docs, line_words=line_dedup.LINE_WORDS))
    gone = (F.size("removed") > 0) & (F.trim("text") == "")
    return _sized(left.where(~F.coalesce(gone, F.lit(False))), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(docs)
    return _sized(found.withColumn("text", secret_scan.redact(F.col("text"), F.col("spans"))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.cut(docs)
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def _sized(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _fresh(stage):
    """The stage, begun with what the one before it left in the executors' heaps given back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", _fresh(quality)),
    ("n-gram Jaccard join", _fresh(near_copies)),
    ("substring dedup", _fresh(shared_passages)),
    ("secret scans", _fresh(secrets)),
    ("packing", _fresh(packed)),
]

#: SQL can't express the classifier; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
