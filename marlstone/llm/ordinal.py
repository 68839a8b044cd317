"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words (and a few figures of the text's shape) gives a score; ordered thresholds cut the
score into grades: P(grade <= k) = sigmoid(threshold_k - score). From it come the expected grade and the tail
probability P(grade >= cut) by which documents are selected.

The model is fitted on the driver to a bounded sample of rated documents, ``sample`` at most: those first in the order of
a hash of their id, so that the choice does not depend on partitions. Their features are made by the executors, from
whole texts. Every document is scored, from its whole text.

Defined results: ratings with a null id, grade or no such document don't count; null text is empty text; rows that
repeat an id are scored each; with no ratings at all the score is 0 for all and every grade is as likely; existing
columns of the names ``expected_grade`` and ``tail`` are replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import quoted

SAMPLE = 12_000
BITS = 18
BLOCK = 1024  # sampled rows whose words are computed at a time on the driver
RARE = 600  # hashed words of fewer than one in so many sampled documents get no weight
SHAPE = 6  # figures of the text's shape, in the first places
_RUNS = re.compile(rb"[!-/:-@\[-`{-~]{2,4}|\|")
_DELETE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def slot(word: bytes) -> int:
    import xxhash

    return SHAPE + xxhash.xxh3_64_intdigest(word) % ((1 << BITS) - SHAPE)


def shape_and_words(text: str | None) -> tuple[list[float], set[bytes]]:
    """Figures of the text's shape, each about 0 to 3, and its distinct words: lower-case words without ASCII
    punctuation, and runs of two to four punctuation marks."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower()
    words = low.translate(_DELETE).split()
    distinct = set(words)
    runs = set(_RUNS.findall(raw))
    n, chars = max(1, len(words)), max(1, len(raw))
    upper = sum(map(raw.count, (b"A", b"E", b"I", b"O", b"N", b"R", b"S", b"T")))
    lower = sum(map(raw.count, (b"a", b"e", b"i", b"o", b"n", b"r", b"s", b"t")))
    marks = len(raw) - len(raw.translate(None, b"!#$%&*|+=<>{}[]\\^~@_"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return [
        3 * upper / max(1, upper + lower), min(3.0, 20 * marks / chars), min(3.0, 10 * digits / chars),
        2 * (1 - len(distinct) / n), min(3.0, len(low.split()) / n - 1), min(3.0, 0.3 * chars / n / 2),
    ], distinct | runs


@dataclass(frozen=True)
class Model:
    weights: object  # numpy array
    thresholds: tuple[float, ...]
    n_rated: int

    def tails(self, score):
        """P(grade >= k) for k = 1, 2, ..., of an array of scores."""
        import numpy as np

        return [1 / (1 + np.exp(np.clip(t - score, -60, 60))) for t in self.thresholds]


def features(docs: DataFrame) -> DataFrame:
    """Rows (id, grade, shape, slots) of ``docs`` (id, grade, text)."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            both = [shape_and_words(t.as_py()) for t in batch.column(2)]
            slots = [sorted({slot(w) for w in words}) for _, words in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in both], pa.list_(pa.float64())), pa.array(slots, pa.list_(pa.int32()))], names=["id", "grade", "shape", "slots"])

    return docs.select("id", "grade", "text").mapInArrow(rows, "id long, grade int, shape array<double>, slots array<int>")


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, rounds: int = 300, l2: float = 2e-4) -> Model:
    """``ratings``: columns ``id_col`` and ``grade`` (0 .. grades - 1)."""
    rated = ratings.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade")).where(f"id is not null and grade between 0 and {grades - 1}")
    chosen = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # `sample` short rows at most, also where rows repeat an id
    rows = features(texts.join(F.broadcast(chosen), "id")).orderBy(F.xxhash64("id"), "id", "grade", F.xxhash64("slots", "shape")).limit(sample)
    return fit_rows(rows.toArrow(), grades, rounds, l2)


def fit_rows(rows, grades: int, rounds: int = 300, l2: float = 2e-4) -> Model:
    """Adam on the mean negative log likelihood over all rows at once."""
    import numpy as np
    import pyarrow as pa

    n, size = rows.num_rows, 1 << BITS
    if not n:
        return Model(np.zeros(size), tuple(float(np.log(k / (grades - k))) for k in range(1, grades)), 0)
    y = rows.column("grade").to_numpy()
    shape = rows.column("shape").combine_chunks().flatten().to_numpy().reshape(n, SHAPE)
    seen, total = np.zeros(size, np.int64), 0
    for chunk in rows.column("slots").chunks:
        seen += np.bincount(chunk.flatten().to_numpy(), minlength=size)
        total += len(chunk.flatten())
    used = np.flatnonzero(seen >= max(3, n // RARE))
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    # by blocks of rows, so that what is computed for each word of each row stays small
    blocks, at = [], 0
    for chunk in rows.column("slots").chunks:
        for lo in range(0, len(chunk), BLOCK):
            part = chunk[lo : lo + BLOCK]
            here = place[part.flatten().to_numpy()]
            of = np.repeat(np.arange(len(part), dtype=np.int32), part.value_lengths().to_numpy())
            blocks.append((at, at + len(part), of[here >= 0], here[here >= 0]))
            at += len(part)
    del rows, chunk, part, here, of
    pa.default_memory_pool().release_unused()

    w, v = np.zeros(len(used)), np.zeros(SHAPE)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    first, gaps = np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(np.log(share / (1 - share))), 0.05))
    params = [w, v, np.array([first]), gaps]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        w, v, first, gaps = params
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = shape @ v
        for a, b, of, here in blocks:
            score[a:b] += np.bincount(of, w[here], minlength=b - a)
        below = np.where(y > 0, sigmoid(cuts[np.maximum(y - 1, 0)] - score), 0.0)
        upto = np.where(y < grades - 1, sigmoid(cuts[np.minimum(y, grades - 2)] - score), 1.0)
        p = np.maximum(upto - below, 1e-12)
        d_upto, d_below = upto * (1 - upto) / p / n, below * (1 - below) / p / n
        g_score = d_upto - d_below  # of the negative log likelihood
        g_cuts = np.bincount(np.minimum(y, grades - 2), np.where(y < grades - 1, -d_upto, 0), minlength=grades - 1) + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, d_below, 0), minlength=grades - 1)
        g_gaps = np.array([g_cuts[k + 1 :].sum() for k in range(grades - 2)]) * np.exp(gaps)
        g_w = l2 * w
        for a, b, of, here in blocks:
            g_w += np.bincount(here, g_score[a:b][of], minlength=len(used))
        grads = [g_w, shape.T @ g_score + l2 * v, np.array([g_cuts.sum()]), g_gaps]
        rate = 0.05 * min(1.0, 3 * (1 - (step - 1) / rounds))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-9)
    w, v, first, gaps = params
    weights = np.zeros(size)
    weights[used], weights[:SHAPE] = w, v
    return Model(weights, tuple(float(x) for x in np.concatenate([first, first + np.cumsum(np.exp(gaps))])), n)


def score(docs: DataFrame, model: Model, cut: int, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail``: P(grade >= cut)."""
    kept = [c for c in docs.columns if c not in ("expected_grade", "tail")]

    def rows(batches: Iterator) -> Iterator:
        import math

        import numpy as np
        import pyarrow as pa

        weights, known = model.weights, {}
        shapes = weights[:SHAPE].tolist()
        for batch in batches:
            scores = []
            for t in batch.column("row").field(text_col):
                shape, words = shape_and_words(t.as_py())
                if len(known) > 200_000:
                    known.clear()
                for word in words.difference(known):
                    known[word] = float(weights[slot(word)])
                scores.append(math.fsum(map(known.__getitem__, words)) + math.fsum(a * b for a, b in zip(shape, shapes)))
            tails = model.tails(np.array(scores))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sum(tails)), pa.array(tails[cut - 1])], names=["row", "expected_grade", "tail"])

    rows_in = docs.select(F.struct(*(quoted(c) for c in kept)).alias("row"))
    graded = rows_in.mapInArrow(rows, StructType([rows_in.schema["row"], StructField("expected_grade", DoubleType()), StructField("tail", DoubleType())]))
    return graded.select(*(F.col("row").getField(c).alias(c) for c in kept), "expected_grade", "tail")


#: Grades of the corpus, from the labels: toxic, plain junk, good.
GRADES, GOOD = 3, 2


def ratings(labels: DataFrame) -> DataFrame:
    """``labels`` (doc_id, quality, toxic) as grades."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
