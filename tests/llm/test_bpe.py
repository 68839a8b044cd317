import hashlib

from marlstone.llm import bpe, word_split
from marlstone.llm.queries import op3_bpe

PATH = word_split.tokenizer_path(bpe.BYTE_BPE)
TEXTS = [None, "", " ", "a  b\n\nc \t d", "it's we'll don'tx ''s", "naïve Straße 12345", "x<|endoftext|>y <|endoftext|>", "<|endoftex", "漢字かな交じり", "😀 emoji ՘ odd ᪰", "  nbsp", "a" * 5000, "word " * 3000, "İstanbul ΣΊΣΥΦΟΣ"]


def test_words_equal_those_of_the_library():
    for name in (bpe.BYTE_BPE, "word_bpe_49k.json"):
        t = word_split.load(word_split.tokenizer_path(name))
        s = word_split.Splitter(t)
        for text in TEXTS:
            words = s.split(text or "")
            assert [i for w in word_split.encode_words(t, words) for i in w] == t.encode(text or "", add_special_tokens=False).ids, (name, text)


def test_both_libraries_agree_on_the_fast_characters():
    import regex

    letter, number, space = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")
    pre = word_split.load(PATH).pre_tokenizer
    for c in range(0xA7CE):
        ch = chr(c)
        if not word_split.AGREED.fullmatch(ch):
            continue
        kind = "a" if letter.match(ch) else "1" if number.match(ch) else " " if space.match(ch) else "!"
        if kind != " ":
            assert len(pre.pre_tokenize_str(kind + ch)) == 1, hex(c)
        else:
            assert len(pre.pre_tokenize_str("a" + ch)) == len(pre.pre_tokenize_str("!" + ch)) == 2, hex(c)


def test_round_trip_with_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "same id", "x")], "doc_id long, text string, ids string")
    t = word_split.load(PATH)
    got = bpe.decode(bpe.encode(df, block_chars=4000)).collect()
    assert len(got) == df.count()
    want = sorted((t.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in df.collect())
    assert sorted((r.ids, r.text) for r in got) == want


def test_invalid_bytes_decode_as_in_the_library(spark):
    t = word_split.load(PATH)
    ids = [[i] for i in range(0, 50257, 97)] + [[i, i + 1, i + 2] for i in range(100, 300)] + [[50256, 5, 50256]]
    got = bpe.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")).collect()
    for r in got:
        assert r.text == t.decode(r.ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_query_against_the_library(spark, sf_dir):
    t = word_split.load(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op3_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = t.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
