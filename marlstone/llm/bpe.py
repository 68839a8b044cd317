"""BPE encoding and decoding over a table of distinct words.

Words are split in Spark's tasks. A block of documents (about ``BLOCK_CHARS`` characters) keeps its distinct words once
and, in place of the texts, each word's position as a number. Blocks deal their words to buckets by hash; a bucket
holds every block's copy of the same words, encodes each distinct word once, and sends the ids back to the blocks,
where they are joined to the positions. A word occurs once per block, so a common word is no hot key. Decoding joins ids
with the table of pieces, which is as long as the vocabulary.

Defined results: null text is empty text and has no ids; repeated rows and ids are each encoded; a null id stays null;
other columns are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import delete_at_end, fresh_path, small_batches, trim
from .word_split import BYTE_CHARS, Numbering, Splitter, encode_words, load, tokenizer_path

BLOCK_CHARS = 16_000_000
AT_ONCE = 256  # documents that leave a Python worker at a time
BYTE_BPE = "byte_bpe_50k.json"
_BLOCKS = "block long, doc_ids array<long>, sizes array<int>, n_words int, positions binary, words array<string>"


def pack_ints(values) -> bytes:
    """Unsigned integers below 2**32, byte plane by byte plane, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def split_blocks(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: its documents' ids and word counts, its distinct words, the most frequent first, and the text
    of its documents as places in that list. ``docs``: columns ``doc_id`` and ``text``."""

    def blocks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        splitter = Splitter(load_once(path))
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list[int] = []
        parts: list = []
        known, chars = Numbering(), 0

        def flush():
            nonlocal ids, sizes, parts, known, chars, number
            number += 1
            met = np.concatenate(parts)
            words = np.array(list(known), object)
            order = np.argsort(-np.bincount(met, minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            row = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([len(words)], pa.int32()), pa.array([pack_ints(place[met])], pa.binary()), pa.array([words[order].tolist()], pa.list_(pa.string()))],
                names=["block", "doc_ids", "sizes", "n_words", "positions", "words"],
            )
            ids, sizes, parts, known, chars = [], [], [], Numbering(), 0
            del met, words, order, place
            trim()
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = splitter.split(text)
                ids.append(doc_id)
                sizes.append(len(found))
                parts.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                chars += len(text)
                if chars >= block_chars:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(blocks, _BLOCKS)


def _deal(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (bucket, block, at, words): the words of a block that belong to a bucket, and the steps between their places."""

    def deal(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words.values
                bucket = np.fromiter((zlib.crc32(w.encode()) % n_buckets for w in words.to_pylist()), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                buckets, first = np.unique(bucket[order], return_index=True)
                cuts = np.append(first, len(order))
                at = [pack_ints(np.diff(order[a:b], prepend=0)) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array(np.full(len(buckets), block)), pa.array(at, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(order)))],
                    names=["bucket", "block", "at", "words"],
                )

    return blocks.select("block", "words").mapInArrow(deal, "bucket long, block long, at binary, words array<string>")


def _by_block(blocks: DataFrame) -> DataFrame:
    """``blocks`` written to the shared folder in buckets by block, so that the ids come to them and they stay in place."""
    spark, name = blocks.sparkSession, f"bpe_blocks_{uuid.uuid4().hex}"
    n = max(8, blocks.rdd.getNumPartitions())
    path = fresh_path(spark, "bpe-blocks")
    with small_batches(spark):
        blocks.write.bucketBy(n, "block").option("compression", "zstd").option("path", path).saveAsTable(name)
    delete_at_end(spark, path)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # its files stay
    return table


def encode(docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (``doc_id``, ``ids`` array of int) of ``docs`` (``doc_id``, ``text``). ``path``: a tokenizers file."""
    path = path or tokenizer_path(BYTE_BPE)
    blocks = _by_block(split_blocks(docs, path, block_chars))
    n_buckets = max(16, blocks.count())

    def code(group):
        import numpy as np
        import pyarrow as pa

        lists = group.column("words").combine_chunks()
        words = lists.flatten().dictionary_encode()
        each = encode_words(load_once(path), words.dictionary.to_pylist())
        width = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for x in each for i in x), np.uint32, int(width.sum()))
        first = np.cumsum(width) - width
        index = words.indices.to_numpy(zero_copy_only=False)
        cuts = np.cumsum([0, *map(len, lists)])
        sizes, ids = [], []
        for a, b in zip(cuts, cuts[1:]):
            w = width[index[a:b]]
            to = np.cumsum(w)
            sizes.append(pack_ints(w))
            ids.append(pack_ints(flat[np.repeat(first[index[a:b]] - (to - w), w) + np.arange(to[-1])]))
        return pa.table([group.column("block"), group.column("at"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["block", "at", "sizes", "ids"])

    coded = _deal(blocks, n_buckets).groupBy("bucket").applyInArrow(code, "block long, at binary, sizes binary, ids binary")

    def join(left, right):
        import numpy as np
        import pyarrow as pa

        out_ids, out, done = [], [], []

        def flush():
            """Documents leave in small batches, so that no more is held twice."""
            ends = np.cumsum([0, *map(len, out)])
            flat = np.concatenate(out) if out else np.zeros(0, np.int32)
            done.append(pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"]))
            out_ids.clear(), out.clear()

        for row in left.select(["doc_ids", "sizes", "n_words", "positions"]).to_pylist():
            start_of, width_of, ids, end = np.empty(row["n_words"], np.int64), np.empty(row["n_words"], np.int64), [], 0
            for part in right.select(["at", "sizes", "ids"]).to_pylist():
                at, width = np.cumsum(unpack_ints(part["at"]).astype(np.int64)), unpack_ints(part["sizes"]).astype(np.int64)
                start_of[at], width_of[at] = end + np.cumsum(width) - width, width
                ids.append(unpack_ints(part["ids"]))
                end += len(ids[-1])
            ids = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            where, end = unpack_ints(row["positions"]), 0
            for doc_id, size in zip(row["doc_ids"], row["sizes"]):
                words = where[end : end + size]
                end += size
                w = width_of[words]
                to = np.cumsum(w)
                out_ids.append(doc_id)
                out.append(ids[np.repeat(start_of[words] - (to - w), w) + np.arange(to[-1])] if size else np.zeros(0, np.int32))
                if len(out) == AT_ONCE:
                    flush()
        flush()
        trim()
        return pa.Table.from_batches(done)

    left = blocks.select("block", "doc_ids", "sizes", "n_words", "positions")
    return left.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join, "doc_id long, ids array<int>")


_LOADED: dict[str, object] = {}


def load_once(path: str):
    """A worker loads a tokenizer once."""
    if path not in _LOADED:
        _LOADED[path] = load(path)
    return _LOADED[path]


def piece_table(path: str) -> list[bytes]:
    """The bytes that each id stands for, in a byte-level vocabulary; as long as the vocabulary."""
    tokenizer = load_once(path)
    byte_of = {c: b for b, c in BYTE_CHARS.items()}
    special = {i: a.content for i, a in tokenizer.get_added_tokens_decoder().items()}
    pieces = [b""] * tokenizer.get_vocab_size()
    for piece, i in tokenizer.get_vocab().items():
        plain = i in special or any(c not in byte_of for c in piece)
        pieces[i] = piece.encode() if plain else bytes(byte_of[c] for c in piece)
    return pieces


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``text``: ids joined with their pieces, invalid UTF-8 replaced."""
    path = path or tokenizer_path(BYTE_BPE)

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if path not in _PIECES:
            _PIECES[path] = piece_table(path)
        piece = _PIECES[path].__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                done = [b"".join(map(piece, x.values.to_numpy(zero_copy_only=False).tolist())).decode("utf-8", "replace") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(done, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, ids array<int>, text string")


_PIECES: dict[str, list[bytes]] = {}
