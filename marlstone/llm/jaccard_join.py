"""N-gram Jaccard join with a prefix tree.

A document's set holds its distinct word n-grams as 64-bit hashes, globally ordered by hash. Documents with equal sets
are one class, which only its smallest id represents. Two sets at a Jaccard similarity of at least ``num / den`` differ
in few n-grams; the hash range is cut into parts, by the class of the set's size, so that a set has more parts with
n-grams in them than can differ: one of these must be equal in both. A set of which too few parts hold n-grams is cut
again with n-grams hashed anew, up to ``CUTS`` times, and only after the last its empty parts count too, so that sets
that have nothing in common share no part. Documents that share a part are candidates; of parts that the same documents
share, one is kept. A part holds several n-grams picked by hash, so a passage that many documents share seldom fills one.

Candidates are tried in rounds. The first takes three parts of each document, the same for documents that share most:
where groups of copies are large, that joins them with a few comparisons each. Further rounds take all parts whose
documents are still in different components, in blocks of bounded size: each document outside the largest component of
its block is tried against the first and the nearest in another component, round after round while that joins any. The
last round tries all pairs in different components. A trial begins with parity bitmaps, whose distance is never more
than the number of n-grams in which two sets differ; what passes is joined exactly: one document's candidates are stored
in a prefix tree in the global order and the document walks it once. Common beginnings share their partial overlap, and
a branch is left as soon as what remains of both sets can't reach the threshold, or when all below is linked to the
walker already. So the components are those of all links, though copies are never compared in all pairs. Nothing is
dropped or capped.

Defined results: null text is empty text; an empty set is linked with nothing, not even with other empty sets; rows that
repeat an id count as one document each and share its component; a null id has no component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, release, release_executors, trim, written
from .components import connected_components

CUTS = 4  # times a set may be cut into parts before its empty parts count too
TREE_GRAMS = 1_000_000  # n-grams of the sets that one prefix tree holds, a single longer set apart
GROUP = 8192  # documents that share a part and are tried against each other in one piece; a quarter of it before the last round
PLACES = 4  # bits of a parity bitmap for each n-gram; a power of two
SAMPLED = 3  # parts of a document in the first round


def gram_set(text: str | None, n: int, words_seen: dict):
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; with fewer words, of the whole sequence."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and space, \t to \r
    if not words:
        return np.zeros(0, np.uint64)
    if len(words_seen) > 200_000:
        words_seen.clear()
    for w in set(words).difference(words_seen):
        words_seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(words_seen.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        n = len(h)
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def mix(x):
    """The finaliser of splitmix64."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def size_classes(num: int, den: int, most: int) -> list[int]:
    """First sizes of the classes: linked sets lie in one class or two adjoining ones."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * den // num)))
    return starts


def part_count(cls: int, starts: list[int], num: int, den: int) -> int:
    """Parts for class ``cls``, where sets of it meet those of it and the class below: somewhat more than can differ, as
    one in e**(n-grams in a part) is empty."""
    most = starts[cls + 1] - 1
    differ = 2 * most * (den - num) // (den + num)
    return differ + 1 + max(2, differ // 12)


def part_keys(grams, num: int, den: int, starts: list[int]):
    """Keys of the parts of one set, for its own class of size and the next."""
    import numpy as np

    size, out = len(grams), [np.zeros(0, np.uint64)]
    cls = int(np.searchsorted(starts, size, side="right")) - 1
    cuts_of: dict[int, tuple] = {}  # n-grams by turn, with their running sums
    with np.errstate(over="ignore"):
        for c in (cls, cls + 1):
            largest = min(size * den // num, starts[c + 1] - 1)  # set of class c, or below, that this one may be linked to
            differ = (size + largest) * (den - num) // (den + num)
            if largest < starts[c] or not differ:  # no other set of class c can be linked to this one
                continue
            k = part_count(c, starts, num, den)
            cuts = (np.arange(1, k, dtype=np.float64) * (2.0**64 / k)).astype(np.uint64)
            for turn in range(CUTS):
                if turn not in cuts_of:
                    g = np.sort(mix(grams + np.uint64(turn))) if turn else grams
                    cuts_of[turn] = g, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g), dtype=np.uint64)])
                g, sums = cuts_of[turn]
                at = np.concatenate([[0], np.searchsorted(g, cuts), [size]])
                width = np.diff(at)
                seed = mix((np.arange(k, dtype=np.uint64) << np.uint64(32)) + np.uint64(c + 1) + np.uint64(turn << 24))
                keys = mix((sums[at[1:]] - sums[at[:-1]]) ^ seed ^ mix(width.astype(np.uint64)))
                held = width > 0
                enough = int(held.sum()) > differ
                out.append(keys if turn == CUTS - 1 and not enough else keys[held])
                if enough:
                    break
    return np.concatenate(out)


def parity(grams) -> bytes:
    """A bit for each place an n-gram may hash to, set if an odd number does; ``PLACES`` for an n-gram, or up to twice as many."""
    import numpy as np

    m = max(64, PLACES << (len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def fold(bits: bytes, size: int) -> bytes:
    """The bitmap of ``size`` bytes that a longer one stands for."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "little") ^ int.from_bytes(bits[half:], "little")).to_bytes(half, "little")
    return bits


def may_link(size_a: int, bits_a: bytes, size_b: int, bits_b: bytes, num: int, den: int) -> bool:
    """False only if the sizes or the bitmaps rule a link out."""
    if min(size_a, size_b) * den < max(size_a, size_b) * num:
        return False
    n = min(len(bits_a), len(bits_b))
    apart = (int.from_bytes(fold(bits_a, n), "little") ^ int.from_bytes(fold(bits_b, n), "little")).bit_count()
    return apart * (den + num) <= (size_a + size_b) * (den - num)


MOST = 1 << 34  # sizes beyond this have no class; no text is that long


def sets_of(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Rows (id, size, h, bits, keys) of ``docs`` (id, text): the size of the set, a 128-bit digest of it, its parity
    bitmap, its part keys."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        starts, seen = size_classes(num, den, MOST), {}
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, batch.num_rows, 512):
                size, digest, bits, keys = [], [], [], []
                for text in batch.column(1)[lo : lo + 512]:
                    g = gram_set(text.as_py(), n, seen)
                    size.append(len(g))
                    digest.append(xxhash.xxh3_128_digest(g.tobytes()))
                    bits.append(parity(g))
                    keys.append(part_keys(g, num, den, starts) if len(g) else g)
                ends = np.cumsum([0, *map(len, keys)])
                flat = pa.array(np.concatenate(keys).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["id", "size", "h", "bits", "keys"])
            trim()

    return docs.mapInArrow(rows, "id long, size long, h binary, bits binary, keys array<long>")


def grams_of(docs: DataFrame, n: int) -> DataFrame:
    """Rows (id, grams) of ``docs`` (id, text); ``grams``: sorted unsigned 64-bit integers, big-endian."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                grams = [gram_set(t.as_py(), n, seen).astype(">u8").tobytes() for t in batch.column(1)[lo : lo + 256]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 256], pa.array(grams, pa.binary())], names=["id", "grams"])

    return docs.mapInArrow(rows, "id long, grams binary")


class Forest:
    """Union-find over places in a block."""

    def __init__(self, n: int):
        self.up, self.trees = list(range(n)), n

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.trees -= 1
        return True


def tree_join(sets: list[bytes], num: int, den: int, forest: Forest, walkers: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between places of ``sets`` (each sorted, big-endian) that join two trees of ``forest``, which they update.

    The prefix tree is kept compressed: a node is a run of n-grams that all sets below it have at the same depths.
    """
    import numpy as np

    order = sorted(range(len(sets)), key=sets.__getitem__)
    arrays = [np.frombuffer(sets[i], ">u8").astype(np.uint64) for i in order]

    def common(i: int) -> int:
        a, b = arrays[i - 1], arrays[i]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    links: list[tuple[int, int]] = []
    shared = [0] + [common(i) for i in range(1, len(arrays))] + [0]
    size = np.array([len(a) for a in arrays], np.int64)

    # nodes by preorder: (first set, past last set, depth from, depth to, past the subtree, least and most size below)
    nodes: list[list[int]] = []

    def build() -> None:
        todo: list[tuple] = [("open", 0, len(arrays), 0)]
        while todo:
            what, lo, hi, depth = todo.pop()
            if what == "close":
                nodes[lo][4] = len(nodes)
                continue
            if hi - lo == 1:
                nodes.append([lo, hi, depth, len(arrays[lo]), len(nodes) + 1, int(size[lo]), int(size[lo])])
                continue
            to = min(shared[lo + 1 : hi])
            nodes.append([lo, hi, depth, to, 0, int(size[lo:hi].min()), int(size[lo:hi].max())])
            todo.append(("close", len(nodes) - 1, 0, 0))
            cuts = [lo] + [i for i in range(lo + 1, hi) if shared[i] == to] + [hi]
            todo.extend(("open", a, b, to) for a, b in reversed(list(zip(cuts, cuts[1:]))))

    if arrays:
        build()
    place = np.array(order)
    for x in range(len(arrays)) if walkers is None else sorted(walkers, key=lambda w: len(sets[w])):
        if walkers is not None:
            me, mine = x, np.frombuffer(sets[x], ">u8").astype(np.uint64)
        else:
            me, mine = int(place[x]), arrays[x]
        if not len(mine):
            continue
        n = len(mine)
        overlap_at: list[tuple[int, int]] = []  # (past the subtree, overlap of the path down to its node)
        at = 0
        while at < len(nodes):
            lo, hi, d0, d1, past, least, most = nodes[at]
            while overlap_at and at >= overlap_at[-1][0]:
                overlap_at.pop()
            overlap = overlap_at[-1][1] if overlap_at else 0
            if most * den < n * num or least * num > n * den or (walkers is None and hi <= x + 1):
                at = past
                continue
            root = forest.root(me)
            if hi - lo <= 64 and all(forest.root(order[i]) == root for i in range(lo, hi)):
                at = past
                continue
            run = arrays[lo][d0:d1]
            used = 0
            if len(run):
                where = np.searchsorted(mine, run)
                overlap += int(np.count_nonzero(mine[np.minimum(where, n - 1)] == run))
                used = int(np.searchsorted(mine, run[-1], side="right"))
            elif d0:
                used = int(np.searchsorted(mine, arrays[lo][d0 - 1], side="right"))
            # the most that sets below can still share, at the sizes that suit it best
            t = max(least, -(-n * num // den))
            reach = overlap + min(n - used, most - d1)
            if reach * (num + den) < num * (n + t):
                at = past
                continue
            if hi - lo == 1:
                j = order[lo]
                if j != me and den * overlap >= num * (n + d1 - overlap) and forest.join(me, j):
                    links.append((me, j))
                    if forest.trees == 1:
                        return links
            overlap_at.append((past, overlap))
            at += 1
    return links


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", tree_grams: int = TREE_GRAMS, group: int = GROUP) -> DataFrame:
    """Rows (``id_col``, ``n_shingles``, ``component_id``), one for each of ``docs``: the size of its set and the smallest
    id reachable by links, two documents being linked when ``den`` times the common n-grams >= ``num`` times all of theirs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = written(sets_of(docs, n, num, den), "jaccard-keys")
    classes = keyed.where("size > 0 and id is not null").groupBy("size", "h").agg(F.min("id").alias("rep"))
    reps = keyed.where("size(keys) > 0").select("id", "keys").join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")

    rep_keys = written(reps, "jaccard-rep-keys")
    sets = written(keyed.select("id", "size", "h", "bits"), "jaccard-sets")
    drop_written(keyed)
    release(spark)
    release_executors(spark)

    # documents that share a part, for one part of those that the same documents share
    by_key = Window.partitionBy("key")
    lo, hi, m, who = F.min("id").over(by_key), F.max("id").over(by_key), F.count(F.lit(1)).over(by_key), F.bit_xor(F.xxhash64("id")).over(by_key)
    shared = written(rep_keys.select("id", F.explode("keys").alias("key")).select("key", "id", lo.alias("lo"), hi.alias("hi"), m.alias("m"), who.alias("who")).where("lo <> hi"), "jaccard-shared")
    drop_written(rep_keys)
    release(spark)
    one = shared.where("id = lo").groupBy("lo", "hi", "m", "who").agg(F.min("key").alias("key")).select("key")
    parts = written(shared.join(one, "key", "left_semi").select("key", "id").distinct(), "jaccard-parts")
    drop_written(shared)
    release(spark)
    release_executors(spark)
    bits = sets.where("size > 0").select("id", "size", "bits")

    found = tried = None
    last = grew = False
    for turn in count():
        if turn:
            some = parts
        else:
            picks = [F.min_by("key", F.xxhash64("key", F.lit(k))).alias(f"k{k}") for k in range(SAMPLED)]
            some = parts.groupBy("id").agg(*picks).select(F.explode(F.array_distinct(F.array(*(f"k{k}" for k in range(SAMPLED))))).alias("key"), "id")
        named = some.withColumn("label", F.col("id"))
        if found is not None:
            named = some.join(found, some["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("label"))
        many = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
        odd = named.join(many.select("key", F.ceil(F.col("m") / (group if last else max(2, group // 4))).cast("int").alias("n_blocks")), "key").join(bits, "id")
        dealt = odd.withColumn("block", F.pmod(F.xxhash64("id", F.lit(turn)), "n_blocks").cast("int"))
        if last:  # all blocks of a part meet
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        else:
            dealt = dealt.withColumn("other", F.col("block"))
        met = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "label", "size", "bits", "n_blocks")
        met = met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", F.xxhash64("id", F.lit(turn)), "id")
        near = written(met.mapInArrow(_across(num, den, every=last), "key long, a long, b long"), "jaccard-near")
        pairs = near.where("a is not null").select("a", "b").distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        more = written(_verify(pairs, docs, bits, n, num, den, tree_grams), "jaccard-links")
        grew = not more.isEmpty()
        if grew or found is None:
            links = more if found is None else more.unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            before, found = found, written(connected_components(links), "jaccard-labels")
            if before is not None:
                drop_written(before)
        drop_written(more)
        if last:
            drop_written(near, pairs, parts)
            break
        tried, before = (pairs, None) if tried is None else (written(tried.unionAll(pairs), "jaccard-tried"), tried)
        if before is not None:
            drop_written(before, pairs)
        if turn:  # where no two may link across components now, none may later
            parts, before = written(parts.join(near.select("key").distinct(), "key", "left_semi"), "jaccard-parts"), parts
            drop_written(before)
        drop_written(near)
        release(spark)
        last = turn > 0 and not grew
    drop_written(tried)

    classes = sets.where("size > 0 and id is not null").groupBy("size", "h").agg(F.min("id").alias("rep"))
    classes = classes.join(found, classes["rep"] == found["node"], "left").select("size", "h", F.coalesce("component", "rep").alias("component"))
    same_id = sets.where("size > 0 and id is not null").join(classes, ["size", "h"]).groupBy("id").agg(F.min("component").alias("component"))
    mine = sets.select("id", "size").join(same_id, "id", "left")
    return mine.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _pairs(pairs: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def _across(num: int, den: int, every: bool):
    """Of rows (key, p, q, block, id, label, size, bits, n_blocks), sorted by the first three, pairs (key, a, b) of different
    labels that may link, within a block if p = q, else between the two: ``every`` such pair, or for each row outside the
    largest component the nearest and the first. A part of several blocks is named with no pair, unless ``every``."""

    def chosen(where, apart, other) -> list[int]:
        """Places among ``where`` to try."""
        if every or len(where) < 2:
            return where
        return where[sorted({0, int(apart.argmin())})]

    def work(rows: list, across: bool) -> Iterator[tuple]:
        """Rows of one piece; yields (id, ids to try it with)."""
        import numpy as np

        n = min(len(r[4]) for r in rows)
        words = np.frombuffer(b"".join(fold(r[4], n) for r in rows), np.uint64).reshape(len(rows), -1)
        block, ids, labels, sizes = (np.array([r[k] for r in rows]) for k in range(4))
        names, nth, times = np.unique(labels, return_inverse=True, return_counts=True)
        walkers = np.flatnonzero(nth != times.argmax())
        pending = np.ones(len(rows), bool)
        for i in walkers:
            pending[i] = False
            other = (labels != labels[i]) & (ids != ids[i])
            if every:  # rows that have walked have met this one
                other &= pending
            if across:
                other &= block != block[i]
            where = np.flatnonzero(other)
            small, large = np.minimum(sizes[where], sizes[i]), np.maximum(sizes[where], sizes[i])
            where = where[small * den >= large * num]
            apart = np.bitwise_count(words[where] ^ words[i]).sum(1)
            fine = apart * (den + num) <= (sizes[where] + sizes[i]) * (den - num)
            where = chosen(where[fine], apart[fine], ids)
            if len(where):
                yield int(ids[i]), ids[where]

    def few(rows: list, across: bool) -> Iterator[tuple]:
        """As above, for a handful of rows."""
        labels = [r[2] for r in rows]
        largest = max(labels, key=labels.count)
        n = min(len(r[4]) for r in rows)
        words = [int.from_bytes(fold(r[4], n), "little") for r in rows]
        walked = set()
        for i, (block, me, label, size, _) in enumerate(rows):
            if label == largest:
                continue
            walked.add(i)
            fine = []
            for j, (b, other, name, s, _) in enumerate(rows):
                if name == label or other == me or across and b == block or every and j in walked or min(s, size) * den < max(s, size) * num:
                    continue
                apart = (words[i] ^ words[j]).bit_count()
                if apart * (den + num) <= (s + size) * (den - num):
                    fine.append((apart, other))
            if fine:
                yield me, [o for _, o in fine] if every else list({fine[0][1], min(fine)[1]})

    def groups(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        out: list = [[], [], []]

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key", "a", "b"])
            for x in out:
                x.clear()
            return batch

        def piece(now: tuple, rows: list, n_blocks: int) -> Iterator:
            if n_blocks > 1 and not every:
                out[0].append(now[0]), out[1].append(None), out[2].append(None)
            if len(rows) > 1 and any(r[2] != rows[0][2] for r in rows):
                for me, others in (few if len(rows) <= 16 else work)(rows, now[1] != now[2]):
                    for x in others:
                        x = int(x)
                        out[0].append(now[0]), out[1].append(min(me, x)), out[2].append(max(me, x))
                    if len(out[0]) > 20_000:
                        yield flushed()

        now, rows, n_blocks = None, [], 0
        for batch in batches:
            c = [batch.column(k).to_pylist() for k in ("key", "p", "q", "n_blocks", "block", "id", "label", "size", "bits")]
            for key, p, q, blocks, *row in zip(*c):
                if (key, p, q) != now:
                    if rows:
                        yield from piece(now, rows, n_blocks)
                    now, rows, n_blocks = (key, p, q), [], blocks
                rows.append(row)
        if rows:
            yield from piece(now, rows, n_blocks)
        if out[0]:
            yield flushed()

    return groups


def _verify(pairs: DataFrame, docs: DataFrame, bits: DataFrame, n: int, num: int, den: int, tree_grams: int) -> DataFrame:
    """The links among ``pairs`` (a, b): for each ``a`` its candidates meet in prefix trees of bounded size, and ``a`` walks each."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    grams = grams_of(docs.join(ids, "id", "left_semi").select("id", "text"), n)
    total = pairs.join(bits.select(F.col("id").alias("b"), "size"), "b").groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / tree_grams)).cast("int").alias("trees"))
    held = pairs.join(total, "a").select("a", F.pmod(F.xxhash64("b"), "trees").cast("int").alias("tree"), F.col("b").alias("id"))
    walkers = total.select("a", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), F.col("a").alias("id"))
    met = held.unionByName(walkers).join(grams, "id").withColumn("g", F.struct("a", "tree")).repartition("g").sortWithinPartitions("a", "tree", "id").drop("g")

    def walk(batches: Iterator) -> Iterator:
        def work(a: int, rows: list) -> list[tuple[int, int]]:
            me = [i for i, r in enumerate(rows) if r[0] == a]  # more than one only where rows repeat an id
            return [(rows[i][0], rows[j][0]) for i, j in tree_join([r[1] for r in rows], num, den, Forest(len(rows)), me)]

        now, rows = None, []
        for batch in batches:
            for a, tree, i, g in zip(batch.column("a").to_pylist(), batch.column("tree").to_pylist(), batch.column("id").to_pylist(), batch.column("grams")):
                if (a, tree) != now:
                    if len(rows) > 1:
                        yield _pairs(work(now[0], rows))
                    now, rows = (a, tree), []
                rows.append((i, g.as_py()))
        if len(rows) > 1:
            yield _pairs(work(now[0], rows))

    return met.select("a", "tree", "id", "grams").mapInArrow(walk, "a long, b long")
