"""Packing by shortest-pack-first over the length histogram.

Texts become ids and are cut into pieces of at most ``width``. Only the histogram of lengths, ``width`` numbers, reaches
the driver: lengths are placed longest first, each into the shortest pack, that is the pattern with the most room, as many
copies at a time as both counts allow; where even that has too little room, a new pack is begun. The patterns (their
number depends on ``width``, not on the corpus) are joined back to the pieces by rank within their length. Ranks need no
shuffle of whole lengths: a piece is numbered within the task that cut it, and tasks' counts are summed up in a table of
a row a task.

Sequences are padded to ``width``, except those whose length is a power of two.

Defined results: null text is empty text, whose only id is the end mark; rows that repeat an id are separate documents;
a null id stays null; other columns of documents are not carried, those of pieces are, whatever their names, but for
``task``, ``rank``, ``sequence_id`` and ``offset``.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import quoted, written
from .word_split import FAST_LOWER_WORDS, Splitter, encode_words, load, tokenizer_path

WORD_BPE = "word_bpe_49k.json"
WIDTH = 2048
END_ID = 1
CACHE_PARTS = 800_000  # parts of texts whose ids a worker remembers before it starts anew


class Parts(dict):
    """Ids, as bytes, of the parts of texts between white space; found when they are first asked for."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, part: str) -> bytes:
        if part.isalpha():
            ids = self.words([part])
        elif part[:-1].isalpha() and not part[-1].isalnum():
            ids = self[part[:-1]] + self[part[-1]]
        else:
            ids = self.words(FAST_LOWER_WORDS.findall(part))
        self[part] = ids
        return ids

    def words(self, words: list[str]) -> bytes:
        return array("I", [i for x in encode_words(self.tokenizer, words) for i in x]).tobytes()


class Coder:
    """Ids of texts, as bytes. A worker has one for all of its tasks, so that it encodes few parts twice."""

    _kept: dict[str, Coder] = {}

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.splitter, self.parts = Splitter(self.tokenizer), Parts(self.tokenizer)

    def encode(self, text: str) -> bytes:
        chunks = self.splitter.chunks(text)
        if chunks is None:
            return self.parts.words(self.splitter.split(text))
        if len(self.parts) > CACHE_PARTS:
            self.parts = Parts(self.tokenizer)
        return b"".join(map(self.parts.__getitem__, chunks))


def cut(docs: DataFrame, path: str | None = None, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``), written to the shared folder: doc_id, start, length, doc_tokens, ids
    (little-endian unsigned 32-bit), task and rank (the piece's number within its task among those of its length)."""
    path = path or tokenizer_path(WORD_BPE)

    def pieces(batches: Iterator) -> Iterator:
        import struct

        import pyarrow as pa
        from pyspark import TaskContext

        coder, counts = Coder.of(path), [0] * (width + 1)
        task, mark = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(batch.column(0)[lo : lo + 256].to_pylist(), batch.column(1)[lo : lo + 256]):
                    data = coder.encode(text.as_py() or "") + mark
                    total = len(data) // 4
                    for start in range(0, total, width):
                        size = min(width, total - start)
                        for column, value in zip(out, (doc_id, start, size, total, data[4 * start : 4 * (start + size)], counts[size])):
                            column.append(value)
                        counts[size] += 1
                doc_ids, starts, sizes, totals, ids, ranks = out
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(ids), pa.int32()), pa.array(ranks, pa.int64())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "task", "rank"],
                )

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, task int, rank long"
    return written(docs.select("doc_id", "text").mapInArrow(pieces, schema), "packing-pieces")


def plan_patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (count, ((length, times), ...)), lengths falling, such that every piece has a place."""
    room: dict[int, dict[tuple, int]] = {}  # room left -> pattern -> count
    rooms: list[int] = []  # a heap of the rooms, largest first, and of some that are gone

    def put(pattern: tuple, count: int, left: int) -> None:
        if left not in room:
            room[left] = {}
            heapq.heappush(rooms, -left)
        room[left][pattern] = room[left].get(pattern, 0) + count

    def largest() -> int:
        while rooms and -rooms[0] not in room:
            heapq.heappop(rooms)
        return -rooms[0] if rooms else 0

    for length in sorted((x for x, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            most = largest()
            if most < length:  # new packs: the first is the shortest until it is full, then the next
                times = width // length
                if left >= times:
                    put(((length, times),), left // times, width - times * length)
                if left % times:
                    put(((length, left % times),), 1, width - left % times * length)
                break
            pattern, count = room[most].popitem()
            if not room[most]:
                del room[most]
            # a piece for each of these packs, and again as long as no other has more room
            times = min(most // length, max(1, -((largest() - most) // length)), max(1, left // count))
            used = min(count, left)
            if used < count:
                put(pattern, count - used, most)
            if pattern[-1][0] == length:
                longer = (*pattern[:-1], (length, pattern[-1][1] + times))
            else:
                longer = (*pattern, (length, times))
            put(longer, used, most - times * length)
            left -= used * times
    return sorted(((c, p) for patterns in room.values() for p, c in patterns.items()), key=lambda x: x[1], reverse=True)


def place(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """``pieces`` (columns ``length``, ``task``, ``rank`` and any others) with ``sequence_id`` and ``offset``."""
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # at most `width` rows

    # slots of each length: ranks from .. to, in sequences first, first + 1, ..., `times` in each, from `offset` on
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for count, pattern in plan_patterns(histogram, width):
        offset = 0
        for length, times in pattern:
            slots.setdefault(length, []).append((used.get(length, 0), first, times, offset))
            used[length] = used.get(length, 0) + count * times
            offset += length * times
        first += count

    kept = [c for c in pieces.columns if c not in ("task", "rank", "sequence_id", "offset")]

    def seats(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tables = {length: np.array(rows, np.int64) for length, rows in slots.items()}
        for batch in batches:
            rank, length = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("nth", "length"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                here = length == x
                t = tables[int(x)]
                row = t[np.searchsorted(t[:, 0], rank[here], side="right") - 1]
                nth = rank[here] - row[:, 0]
                sequence[here] = row[:, 1] + nth // row[:, 2]
                offset[here] = row[:, 3] + nth % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    # a row a task: the number of pieces of each length that tasks before it cut
    bases = counts.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases"))
    rows = pieces.select("task", "length", "rank", F.struct(*(quoted(c) for c in kept)).alias("row"))
    ranked = rows.join(bases, "task").select((F.col("bases")[F.col("length")] + F.col("rank")).alias("nth"), "length", "row")
    seated = ranked.mapInArrow(seats, StructType([ranked.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    return seated.select(*(F.col("row").getField(c).alias(c) for c in kept), "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH) -> DataFrame:
    """Pieces with their ids and places: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return place(cut(docs, path, width), width)
