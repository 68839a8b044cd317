import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from marlstone.llm import packing, word_split
from marlstone.llm.queries import op7_packing

PATH = word_split.tokenizer_path(packing.WORD_BPE)


def padding(lengths, width):
    return sum(0 if n & (n - 1) == 0 else width - n for n in lengths)


def test_patterns_place_every_piece():
    r = random.Random(3)
    for width in (8, 64, 2048):
        histogram = Counter(min(width, int(r.expovariate(5 / width)) + 1) for _ in range(5000))
        patterns = packing.plan_patterns(histogram, width)
        placed = Counter()
        for count, pattern in patterns:
            assert sum(a * b for a, b in pattern) <= width
            for length, times in pattern:
                placed[length] += count * times
        assert placed == histogram
        total = sum(a * b for a, b in histogram.items())
        assert sum(c for c, _ in patterns) * width < 1.02 * total + width
    assert packing.plan_patterns({}) == []


def literal(lengths, width):
    """Room left in each pack, one piece placed after another: longest first, each into the pack with the most room."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        best = max(rooms, default=0)
        if best >= x:
            rooms[rooms.index(best)] -= x
        else:
            rooms.append(width - x)
    return sorted(rooms)


def test_shortest_pack_first():
    named = lambda lengths, width: sorted(p for c, p in packing.plan_patterns(Counter(lengths), width) for _ in range(c))
    assert named([6, 5, 3, 1], 10) == [((5, 1), (3, 1)), ((6, 1), (1, 1))]
    assert named([4, 4, 4, 2, 2, 2], 10) == [((4, 1), (2, 3)), ((4, 2),)]
    r = random.Random(9)
    for _ in range(300):
        width = r.choice([5, 10, 16, 37])
        lengths = [min(width, int(r.expovariate(r.choice([2, 4, 9]) / width)) + 1) for _ in range(r.randrange(1, 120))]
        rooms = [width - sum(a * b for a, b in p) for p in named(lengths, width)]
        assert sorted(rooms) == literal(lengths, width)


def test_columns_of_pieces_are_carried(spark):
    df = spark.createDataFrame([(i, "a b c " * i) for i in range(20)], "doc_id long, text string").repartition(3)
    pieces = packing.cut(df).select("*", packing.F.lit(7).alias("base"), packing.F.lit("n").alias("nth"), packing.F.col("start").alias("bases"), packing.F.lit(-5).alias("offset"), packing.F.lit(1).alias("odd `name"))
    got = packing.place(pieces).collect()
    assert all((r.base, r.nth, r.bases, r["odd `name"]) == (7, "n", r.start, 1) and r.offset >= 0 for r in got) and len(got) == 20


def check(rows, docs, width):
    t = word_split.load(PATH)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [packing.END_ID], "<u4") for i, x in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for i in docs:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids[i])
    ends = []
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= width
        ends.append(at)
    return padding(ends, width) / max(1, sum(map(len, ids.values())))


def test_query_against_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check(op7_packing(spark, sf_dir).collect(), docs, packing.WIDTH) < 0.03


def test_odd_rows(spark):
    texts = [None, "", " ", "It's  ÉCOLE 123", "İstanbul ΣΊΣΥΦΟΣ", "<|endoftext|>x", "漢字 é", "word " * 9000, "A" * 3000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length long").repartition(3)
    got = packing.pack(df).withColumn("ids_crc32", packing.F.crc32("ids")).collect()
    check(got, dict(enumerate(texts)), packing.WIDTH)
    twice = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in packing.pack(twice).collect()) == ["1", "1", "None"]
    assert packing.pack(df.limit(0)).count() == 0
