"""Substring dedup by hashing lines, and stretches of words in them.

A text is a sequence of words between white space, lower-cased to be compared. It has two kinds of units: whole lines of
``line_words`` words or more, and stretches of ``SPAN`` words, across lines, at places that their own content picks: of
``PICK`` neighbouring stretches the one with the smallest hash (winnowing). So two texts that share ``SPAN + PICK - 1``
words in a row share a unit wherever these words stand, and all but at most ``PICK - 1`` words at either end of a shared
passage lie in shared units. Digests are grouped over all documents; the occurrence in the document ranked first
(smallest id), first in its text, stays, and the others are repeats. A repeated line goes, however short the run it stands
in; repeated stretches go where they add up, overlapping or touching, to ``min_words`` words or more, so that phrases that
any two texts have in common stay where they are. Every word that goes stands in such a unit of an earlier document, or
earlier in its own. Offsets are those of the original text, in code points.

A digest that very many documents share is counted map-side first; the join back meets one row for it, and Spark can
split its other side.

Defined results: null and empty texts have no units; rows that repeat an id, and rows with a null id (ranked last), count
as one document each time, whose rows are not repeats of each other; extra columns are ignored by ``repeats`` and kept
by ``remove``, where the name ``removed`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, quoted, release, trim, written
from .jaccard_join import mix

MIN_WORDS = 20
#: Whole lines of fewer words stay: list marks, single words, short headings.
LINE_WORDS = 3
SPAN = 8  # words of a stretch
PICK = 6  # neighbouring stretches of which one is taken
LAST = (1 << 63) - 1


def word_starts(text: str):
    """Where the words of ``text.split()`` begin, and the number of line ends before each."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    held = np.concatenate([[False], ~_blank()[np.minimum(points, 0x3001)]])
    starts = np.flatnonzero(held[1:] & ~held[:-1])
    return starts, np.cumsum(points == 10)[starts]


def _blank(kept: list = []):  # noqa: B006
    """For each code point up to U+3000, the last one that is white space, whether it is; and False."""
    import numpy as np

    if not kept:
        kept.append(np.array([chr(c).isspace() for c in range(0x3001)] + [False]))
    return kept[0]


def stretches(h):
    """Places and digests of the stretches that are units, of a text's hashed words."""
    import numpy as np

    m = len(h) - SPAN + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SPAN):
            g = (g ^ h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
    g = mix(g)
    if m <= PICK:
        at = np.array([m - 1 - int(g[::-1].argmin())])
    else:
        near = np.lib.stride_tricks.sliding_window_view(g, PICK)[:, ::-1]
        picked = np.arange(PICK - 1, m) - near.argmin(1)  # never falls
        at = picked[np.concatenate([[True], picked[1:] != picked[:-1]])]
    return at, g[at]


def units_of(docs: DataFrame, line_words: int | None = None) -> DataFrame:
    """Rows (id, hash, steps, spans, lines, back, d1, d2) of ``docs`` (id, text, hash). ``steps``: the place of the first word,
    then from each word to the next, the last to the text's end; ``spans``: places (by word) of the stretches, each as a step
    from the one before; ``lines``: of each line that is a unit its first word and the word after it. For every unit,
    stretches first: ``back``, how many units before it the first equal one stands (0: it is the first), and its digest."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        known: dict[str, int] = {}
        turn, second = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
        none = np.zeros(0, np.int64)

        def lines_of(h, line):
            first = np.flatnonzero(np.diff(line, prepend=-1))
            size = np.diff(first, append=len(h))
            nth = (np.arange(len(h)) - np.repeat(first, size) + 1).astype(np.uint64)
            with np.errstate(over="ignore"):
                m = mix(h ^ (nth * turn))
                one, two = (mix(np.add.reduceat(x, first) ^ size.astype(np.uint64)) for x in (m, (m ^ (m >> np.uint64(31))) * second))
            long = size >= line_words
            return first[long], (first + size)[long], one[long], two[long] | np.uint64(1)

        def first_of(d):
            """How many places before each the first equal one stands."""
            if len(set(d.tolist())) == len(d):
                return np.zeros(len(d), np.int64)
            _, first, number = np.unique(d, return_index=True, return_inverse=True)
            return np.arange(len(d)) - first[number]

        def of(text: str) -> tuple:
            words = text.split()
            if not words:
                return (none,) * 6
            if len(known) > 150_000:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "surrogatepass"))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            starts, line = word_starts(text)
            at, d1 = stretches(h)
            d2, pairs = np.zeros(len(at), np.uint64), none
            back = first_of(d1)
            if line_words is not None:
                a, b, one, two = lines_of(h, line)
                back = np.concatenate([back, first_of(one)])
                d1, d2, pairs = np.concatenate([d1, one]), np.concatenate([d2, two]), np.column_stack([a, b]).ravel()
            return np.diff(starts, prepend=0, append=len(text)), np.diff(at, prepend=0), pairs, back, d1.view(np.int64), d2.view(np.int64)

        kinds = [pa.int32()] * 4 + [pa.int64()] * 2
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                made = [of(text.as_py() or "") for text in batch.column(1)[lo : lo + 128]]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c), kind)) for c, kind in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 128], batch.column(2)[lo : lo + 128], *lists], names=["id", "hash", "steps", "spans", "lines", "back", "d1", "d2"])
            trim()

    return docs.mapInArrow(rows, "id long, hash long, steps array<int>, spans array<int>, lines array<int>, back array<int>, d1 array<long>, d2 array<long>")


def merged(units: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted units (from, to, keeper) joined where they overlap or touch; the keeper is that of the first."""
    out: list[list[int]] = []
    for a, b, keeper in units:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, keeper])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int | None = None) -> DataFrame:
    """Rows (``id_col``, start, end, n_words, first_id, text_hash): the stretches to remove, the document that keeps the
    unit that begins first in it, and Spark's xxhash64 of the whole text, which tells rows of one id apart. They are runs of
    repeated stretches of ``min_words`` words or more and, with ``line_words``, repeated whole lines of so many words;
    those that overlap or touch are one."""
    docs = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    texts = written(units_of(docs, line_words), "dedup-units")
    each = texts.select("id", "hash", F.posexplode(F.arrays_zip("d1", "d2", "back")).alias("at", "u")).where("u.back = 0").select("id", "hash", "at", "u.d1", "u.d2")
    shared = written(each.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last"), "dedup-shared")
    release(docs.sparkSession)
    later = each.join(shared, ["d1", "d2"]).where("id > first").select("id", "hash", F.struct("at", "first").alias("r"))
    found = written(later.groupBy("id", "hash").agg(F.sort_array(F.collect_set("r")).alias("repeats")), "dedup-repeats")
    release(docs.sparkSession)

    def runs(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def of(i: int, known: dict[int, int], spans, lines, back) -> list[tuple[int, int, int]]:
            first = dict(known)
            for at in np.flatnonzero(back).tolist():
                first[at] = known.get(at - int(back[at]), i)
            places = np.cumsum(spans).tolist()
            n = len(places)
            long = [x for x in merged([(places[u], places[u] + SPAN, first[u]) for u in sorted(first) if u < n]) if x[1] - x[0] >= min_words]
            return merged(sorted([*long, *((int(lines[2 * (u - n)]), int(lines[2 * (u - n) + 1]), first[u]) for u in first if u >= n)]))

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids, hashes = batch.column("id").to_pylist(), batch.column("hash").to_pylist()
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(k) for k in ("steps", "spans", "lines", "back"))]
            pairs = batch.column("repeats")
            held, pair_at, pair_first = pairs.is_valid().to_numpy(zero_copy_only=False), pairs.values.field("at").to_numpy(), pairs.values.field("first").to_numpy()
            ends = pairs.offsets.to_numpy()
            for n, i in enumerate(ids):
                steps, spans, lines, back = (v[o[n] : o[n + 1]] for o, v in lists)
                mine = slice(ends[n], ends[n + 1] if held[n] else ends[n])
                gone = of(i, dict(zip(pair_at[mine].tolist(), pair_first[mine].tolist())), spans, lines, back)
                if gone:
                    starts = np.cumsum(steps)
                    for a, b, keeper in gone:
                        for column, value in zip(out, (i, starts[a], starts[b], b - a, keeper, hashes[n])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "start", "end", "n_words", "first_id", "text_hash"])

    only = texts.select("id", "hash", "steps", "spans", "lines", "back")
    candidates = only.join(found, ["id", "hash"], "left").where("repeats is not null or exists(back, x -> x > 0)")
    spans = written(candidates.mapInArrow(runs, "id long, start long, end long, n_words long, first_id long, text_hash long"), "dedup-spans")
    drop_written(texts, shared, found)
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return spans.select(back("id").alias(id_col), "start", "end", "n_words", back("first_id").alias("first_id"), "text_hash")


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of the texts, and ``removed``: those spans, by original offset."""
    of = spans.groupBy(F.coalesce(F.col(id_col), F.lit(LAST)).alias("id"), F.col("text_hash").alias("hash")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("hash"), F.struct(*(quoted(c) for c in docs.columns)).alias("row"))
    text = F.col("row").getField(text_col)
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))).alias("out"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("removed", begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, F.length(text))))
    left = F.when(F.size("removed") > 0, cut).otherwise(text)
    return rows.join(of, ["id", "hash"], "left").select(*((left if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c != "removed"), "removed")
