"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Vectors gain one component that makes all of them equally long, so that the nearest by distance are those with the
largest inner product. They are projected to a few dimensions in several ways, each with its own rotation and shift, and
every projection is ordered along a Hilbert curve: the keys are range-partitioned and sorted by Spark, and rows numbered
along the whole curve. A query meets the rows of its own window of each curve and of the two next to it; the windows'
finds are merged and ranked by the exact score, which gives each query a score to beat.

Then the first curve's rows, in longer pieces, are asked again: a piece's rows lie within a ball, so none of them can
beat centre . query + radius * |query|. Only pieces whose bound reaches a query's score to beat are compared with it.
With this second look (``complete``, the default) the result is exact; without it, it is what the windows found. On
vectors without any structure, bounds exclude little and each query is compared with most pieces, in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids;
vectors of different widths don't meet, each width is searched by itself; equal scores go by the smaller id; rows that
repeat an id with different vectors are rows of their own, each a query of its own (with ranks of its own) and a candidate
of the others, while rows equal in both are one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, runs, usable

CURVES, DIMS, BITS = 4, 6, 10
WINDOW = 256  # rows of a curve's window
PIECE = 8192  # rows of a piece for the second look
AT_ONCE = 256  # queries compared with a piece at a time
SEED = 20


def hilbert_keys(x, bits: int):
    """Places on the Hilbert curve of integer points ``x`` (rows, dims), each coordinate below 2**bits.

    Skilling's transform (2004), for all rows at once.
    """
    import numpy as np

    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            here = (x[i] & q) != 0
            swap = np.where(here, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(here, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projections(width: int, curves: int, dims: int):
    """For each curve, orthonormal directions for vectors of ``width`` + 1 components, and a shift of a cell's size."""
    import numpy as np

    r = np.random.default_rng(SEED)
    return [(np.linalg.qr(r.normal(size=(width + 1, min(dims, width + 1))))[0], r.random(min(dims, width + 1))) for _ in range(curves)]


def exact_scores(x, q):
    """Inner products of rows of ``x`` with ``q`` in double precision, added up from the first component on."""
    import numpy as np

    return np.add.accumulate(x * q, axis=1)[:, -1]


def best(ids, x, q, mine, k: int, floor: float = float("-inf"), rough=None):
    """The ``k`` best rows (score, place) for one query, of those that score ``floor`` or more and are not ``mine``, its own row."""
    import numpy as np

    rough = x @ q if rough is None else rough
    rough = np.where(mine, -np.inf, rough)
    slack = 1e-9 * (1 + np.abs(rough[np.isfinite(rough)]).max(initial=0))
    if len(rough) > k:
        floor = max(floor, np.partition(rough, -k)[-k])
    some = np.flatnonzero((rough >= floor - slack) & ~mine)
    score = exact_scores(x[some], q)
    order = np.lexsort((ids[some], -score))[:k]
    return score[order], some[order]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; ``found``: arrays per query and place, each already the best there."""
    each = found.select("query_id", "query_own", F.explode(F.arrays_zip("ids", "owns", "scores")).alias("x"))
    each = each.select("query_id", "query_own", F.col("x.ids").alias("vec_id"), F.col("x.owns").alias("own"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_own").orderBy(F.desc("score"), "vec_id", "own"))
    return each.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def search(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", complete: bool = True, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of each row for which the column ``is_query`` holds."""
    every = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), is_query.alias("q")).where(usable(F.col("v")) & F.col("id").isNotNull())
    kept = written(every.groupBy("id", "v").agg(F.coalesce(F.bool_or("q"), F.lit(False)).alias("q")), "ann-rows")
    widths = sorted(r["w"] for r in kept.select(F.size("v").alias("w")).distinct().collect()) or [1]  # the widths of vectors in one table are few
    found = [_search(kept.where(F.size("v") == w), w, k, complete, window, piece) for w in widths]
    return reduce(DataFrame.unionByName, found)


def _search(kept: DataFrame, width: int, k: int, complete: bool, window: int, piece: int) -> DataFrame:
    """As above, for rows (id, v, q) of one width."""
    import numpy as np

    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    base = written(kept.withColumns({"norm2": norm2, "own": F.xxhash64("v")}), "ann-vectors")
    longest = base.agg(F.max("norm2")).first()[0] or 1.0
    planes = projections(width, CURVES, DIMS)

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = matrix(part.column("v"))
                more = np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
                x = np.column_stack([x, more]) / np.sqrt(longest)
                for curve, (plane, shift) in enumerate(planes):
                    cells = 1 << BITS
                    # random directions spread a unit vector by about 1 / sqrt(width); the shift moves the grid
                    at = ((x @ plane) * np.sqrt(width + 1) / 8 + 0.5 + shift / 8) * cells
                    key = hilbert_keys(np.clip(at, 0, cells - 1), BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), curve, np.int32)), pa.array(key), part.column("id"), part.column("own"), part.column("v"), part.column("q")], names=["curve", "key", "id", "own", "v", "q"])

    kind = "array<float>" if dict(base.dtypes)["v"] == "array<float>" else "array<double>"
    points = base.select("id", "own", F.col("v").cast(kind).alias("v"), "q").mapInArrow(keyed, f"curve int, key long, id long, own long, v {kind}, q boolean")

    def numbered(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for (curve,), part in runs(batches, ["curve"]):
            n = seen.get(curve, 0)
            seen[curve] = n + part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, task, np.int32)), pa.array(np.arange(n, n + part.num_rows))], names=[*part.schema.names, "task", "nth"])

    in_order = points.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    ordered = written(in_order.mapInArrow(numbered, f"curve int, key long, id long, own long, v {kind}, q boolean, task int, nth long"), "ann-curves")
    sizes = ordered.groupBy("curve", "task").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = ordered.join(before, ["curve", "task"]).withColumn("place", F.col("before") + F.col("nth"))

    # windows of every curve
    here = placed.withColumn("box", F.floor(F.col("place") / window))
    residents = here.select("curve", "box", F.lit(0).alias("role"), "id", "own", "v", F.lit(float("-inf")).alias("floor"))
    near = here.where("q").select("curve", F.explode(F.array(F.col("box") - 1, F.col("box"), F.col("box") + 1)).alias("box"), F.lit(1).alias("role"), "id", "own", "v", F.lit(float("-inf")).alias("floor"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, ids, owns, vecs = None, [], [], []
        for key, part in runs(batches, ["curve", "box", "role"]):
            if key[:2] != now:
                now, ids, owns, vecs = key[:2], [], [], []
            x, who, own = matrix(part.column("v")), part.column("id").to_numpy(), part.column("own").to_numpy()
            if key[2] == 0:
                ids.append(who), owns.append(own), vecs.append(x)
                continue
            if not ids:
                continue
            if len(ids) > 1:
                ids, owns, vecs = [np.concatenate(ids)], [np.concatenate(owns)], [np.concatenate(vecs)]
            floors = part.column("floor").to_numpy()
            for lo in range(0, len(who), AT_ONCE):
                rough = x[lo : lo + AT_ONCE] @ vecs[0].T
                me = slice(lo, lo + AT_ONCE)
                out = [best(ids[0], vecs[0], x[i], (ids[0] == who[i]) & (owns[0] == own[i]), k, floors[i], rough[i - lo]) for i in range(lo, lo + len(rough))]
                lists = [pa.array([y[at] for _, at in out], pa.list_(pa.int64())) for y in (ids[0], owns[0])]
                yield pa.RecordBatch.from_arrays([pa.array(who[me]), pa.array(own[me]), *lists, pa.array([score for score, _ in out], pa.list_(pa.float64()))], names=["query_id", "query_own", "ids", "owns", "scores"])

    def meet(df: DataFrame) -> DataFrame:
        by = df.withColumn("g", F.struct("curve", "box")).repartition("g").sortWithinPartitions("curve", "box", "role").drop("g")
        return by.mapInArrow(compare, "query_id long, query_own long, ids array<long>, owns array<long>, scores array<double>")

    found = _ranked(meet(residents.unionByName(near)), k)
    if not complete:
        return found.select("query_id", "rank", "vec_id", "score")

    # the second look: pieces of the first curve, unless nothing in them can beat what the windows found
    found = written(found, "ann-windows")
    queries = base.where("q").select("id", "own", F.col("v").cast(kind).alias("v"), "norm2")
    floor = found.groupBy(F.col("query_id").alias("id"), F.col("query_own").alias("own")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    asked = queries.join(floor, ["id", "own"], "left").select("id", "own", "v", "norm2", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    longer = placed.where("curve = 0").select("curve", F.floor(F.col("place") / piece).alias("box"), "id", "own", "v")

    def balls(batches: Iterator) -> Iterator:
        """Of the part of a piece in this task: count, sum, and the largest distance from the part's own mean."""
        import pyarrow as pa

        for (box,), part in runs(batches, ["box"]):
            x = matrix(part.column("v"))
            centre = x.mean(0)
            yield pa.RecordBatch.from_arrays([pa.array([box]), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(np.sqrt(((x - centre) ** 2).sum(1)).max())])], names=["box", "centre", "radius"])

    parts = written(longer.select("box", "v").mapInArrow(balls, "box long, centre array<double>, radius double"), "ann-balls")
    dot = lambda v: F.aggregate(F.zip_with(v, "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    reach = dot("v") + F.col("radius") * F.sqrt("norm2") * (1 + 1e-9) + 1e-9
    visited = asked.join(parts, reach >= F.col("floor")).select(F.lit(0).alias("curve"), "box", F.lit(1).alias("role"), "id", "own", "v", "floor").dropDuplicates(["id", "own", "box"])
    again = meet(longer.select("curve", "box", F.lit(0).alias("role"), "id", "own", "v", F.lit(float("-inf")).alias("floor")).unionByName(visited))
    first = found.groupBy("query_id", "query_own").agg(F.collect_list(F.struct("vec_id", "own", "score")).alias("x"))
    first = first.select("query_id", "query_own", F.col("x.vec_id").alias("ids"), F.col("x.own").alias("owns"), F.col("x.score").alias("scores"))
    return _ranked(again.unionByName(first), k).select("query_id", "rank", "vec_id", "score")
