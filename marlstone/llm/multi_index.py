"""Embedding near-dedup over an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has its own codebook, fitted by k-means to a bounded
sample (``SAMPLE`` vectors, first in the order of a hash of their ids). The product of the codebooks is a grid of cells,
and every vector is filed under its cell. A vector visits cells in the order of a lower bound on the distance between it
and anything filed there, nearest first over both halves (the multi-sequence order), and stops when the bound passes the
distance that the similarity allows: then nothing linked can lie further on, and recall is 1 whatever the codebooks. Of two
cells, vectors of the first visit the second; the links found count for both sides. What the cells hold is compared in
double precision, and products within ``CLOSE`` of the limit once more by the plain formula.

Equal vectors of one label are one class, counted and then represented by the smallest id. Cells are dealt in blocks of
bounded size, each met by all visitors of the cell; a block returns each visitor's count of links and a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different widths don't link; rows that repeat an id are vectors of their own and share its
component; a null id takes no part and has a null component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .common import written
from .vectors import matrix, runs, sample_rows, usable

SAMPLE = 4096
CENTRES = 16  # per half
BLOCK = 4096  # vectors of one cell that are compared in one piece
CLOSE = 1e-9
VISITORS = 1024  # visitors compared with a block at a time


def unit(x):
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plain_cosine(x, y) -> float:
    """The cosine of two vectors, sums added up from the first component on."""
    import math

    dot = lambda a, b: sum((p * q for p, q in zip(a.tolist(), b.tolist())), 0.0)
    return dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))


def fit_codebook(x, centres: int, rounds: int = 10):
    """K-means from evenly spaced rows of ``x``; at most ``centres`` distinct centres."""
    import numpy as np

    c = np.unique(x[np.linspace(0, len(x) - 1, min(centres, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def bounds(x, centres):
    """The nearest centre of each row, and lower bounds on its squared distance to what is filed under each centre:
    the largest distance to the plane halfway between that centre and another."""
    import numpy as np

    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 1e-300))
    beyond = ((d[:, :, None] - d[:, None, :]) / (2 * apart)).max(2)
    return d.argmin(1), np.maximum(beyond, 0) ** 2


def visits(low1, low2, most: float) -> list[int]:
    """Cells of the grid in multi-sequence order: by the sum of both halves' bounds, while it is at most ``most``."""
    import heapq

    import numpy as np

    o1, o2 = np.argsort(low1, kind="stable"), np.argsort(low2, kind="stable")
    out, heap, seen = [], [(low1[o1[0]] + low2[o2[0]], 0, 0)], {(0, 0)}
    while heap:
        bound, a, b = heapq.heappop(heap)
        if bound > most:
            break
        out.append(int(o1[a]) * len(low2) + int(o2[b]))
        for p in ((a + 1, b), (a, b + 1)):
            if p not in seen and p[0] < len(low1) and p[1] < len(low2):
                seen.add(p)
                heapq.heappush(heap, (low1[o1[p[0]]] + low2[o2[p[1]]], *p))
    return out


def near_duplicates(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", centres: int = CENTRES, block: int = BLOCK) -> DataFrame:
    """Rows (``id_col``, n_links, component_id, kept) for each of ``rows``."""
    every = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    good = every.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = written(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times")).withColumn("width", F.size("v")), "vector-classes")

    books: dict[int, tuple] = {}
    import numpy as np

    few = sample_rows(classes.select("id", "v", "width"), "id", SAMPLE).toArrow().combine_chunks()
    widths = {r["width"] for r in classes.select("width").distinct().collect()}  # the widths of vectors in one table are few
    for width in widths:
        part = few.filter(np.asarray(few.column("width")) == width) if few.num_rows else few
        x = unit(matrix(part.column("v").combine_chunks())) if part.num_rows else np.eye(1, width)
        h = width // 2
        books[width] = (fit_codebook(x[:, :h], centres), fit_codebook(x[:, h:], centres))

    most = 2 - 2 * least + 1e-9  # squared distance of unit vectors

    def file(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cell, visit = [0] * part.num_rows, [[]] * part.num_rows
                of = part.column("width").to_numpy()
                for width in np.unique(of):
                    here = np.flatnonzero(of == width)
                    x = unit(matrix(part.column("v").take(pa.array(here))))
                    one, two = books[int(width)]
                    n1, low1 = bounds(x[:, : width // 2], one)
                    n2, low2 = bounds(x[:, width // 2 :], two)
                    for k, i in enumerate(here):
                        cell[i] = int(n1[k]) * len(two) + int(n2[k])
                        visit[i] = [c for c in visits(low1[k], low2[k], most) if c >= cell[i]]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("label", "id", "v", "times", "width")] + [pa.array(cell, pa.int32()), pa.array(visit, pa.list_(pa.int32()))], names=["label", "id", "v", "times", "width", "cell", "visit"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.select("label", "id", "v", "times", "width").schema)
    filed = written(classes.select("label", "id", "v", "times", "width").mapInArrow(file, f"{kinds}, cell int, visit array<int>"), "vector-cells")
    held = filed.groupBy("label", "width", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    key = ["label", "width", "cell"]
    residents = filed.select(*key, "id", "v", "times").join(held, key).select(*key, F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), F.lit(True).alias("own"), "id", "v", "times")
    visitors = filed.select("label", "width", F.col("cell").alias("home"), F.explode("visit").alias("cell"), "id", "v", "times").withColumn("own", F.col("home") == F.col("cell")).join(held, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "own", "id", "v", "times")
    met = residents.unionByName(visitors).withColumn("g", F.struct(*key, "block")).repartition("g").sortWithinPartitions("label", "width", "cell", "block", "role")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, ids, vecs, raws, times = None, [], [], [], []
        for k, part in runs(batches, [*key, "block", "role"]):
            if k[:4] != now:
                now, ids, vecs, raws, times = k[:4], [], [], [], []
            raw = matrix(part.column("v"))
            x = unit(raw)
            who, many, own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "times", "own"))
            if k[4] == 0:
                ids.append(who), vecs.append(x), raws.append(raw), times.append(many)
                continue
            if not ids:
                continue
            if len(ids) > 1:
                ids, vecs, raws, times = [np.concatenate(ids)], [np.concatenate(vecs)], [np.concatenate(raws)], [np.concatenate(times)]
            for lo in range(0, len(who), VISITORS):
                me, away = who[lo : lo + VISITORS], ~own[lo : lo + VISITORS]
                rough = x[lo : lo + VISITORS] @ vecs[0].T
                linked = rough >= least
                for i, j in zip(*np.nonzero(np.abs(rough - least) <= CLOSE)):
                    linked[i, j] = plain_cosine(raw[lo + i], raws[0][j]) >= least
                linked &= me[:, None] != ids[0][None]
                count, back = linked @ times[0], (linked & away[:, None]).T @ many[lo : lo + VISITORS]
                # spanning forest: everything takes the smallest id within reach
                a, b = me.copy(), ids[0].copy()
                while True:
                    a2 = np.minimum(a, np.where(linked, b[None], np.iinfo(np.int64).max).min(1))
                    b2 = np.minimum(b, np.where(linked, a2[:, None], np.iinfo(np.int64).max).min(0))
                    if (a2 == a).all() and (b2 == b).all():
                        break
                    a, b = a2, b2
                some, rest = count > 0, (b != ids[0]) | (back > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([me[some], ids[0][rest]])), pa.array(np.concatenate([a[some], b[rest]])), pa.array(np.concatenate([count[some], back[rest]]))], names=["a", "b", "n"])

    links = written(met.drop("g").mapInArrow(compare, "a long, b long, n long"), "vector-links")
    groups = connected_components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    known = classes.select("label", "v", "times", F.col("id").alias("rep")).join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    placed = good.join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = every.where(~(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return placed.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
