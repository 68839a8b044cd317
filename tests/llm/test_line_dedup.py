import random

import xxhash

from marlstone.llm import line_dedup as d
from marlstone.llm.queries import op5_line_dedup

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def words_of(text):
    """(start, word) of a text, by looking at each character."""
    out, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        out.append((at, w))
        at += len(w)
    return out


def units_of(text, line_words):
    """(from word, to word, what is compared) of every unit, stretches first."""
    words = words_of(text)
    low = [w.lower() for _, w in words]
    hashes = []
    for i in range(len(low) - d.SPAN + 1):
        g = 0
        for w in low[i : i + d.SPAN]:
            g = (g ^ xxhash.xxh3_64_intdigest(w.encode())) * 0x9E3779B97F4A7C15 & MASK
        hashes.append(mixed(g))
    picked = set()
    for i in range(max(1, len(hashes) - d.PICK + 1) if hashes else 0):
        near = hashes[i : i + d.PICK]
        picked.add(i + max(k for k, g in enumerate(near) if g == min(near)))
    out = [(i, i + d.SPAN, tuple(low[i : i + d.SPAN])) for i in sorted(picked)]
    if line_words is not None:
        line = [text.count("\n", 0, a) for a, _ in words]
        for n in sorted(set(line)):
            a, b = line.index(n), len(line) - line[::-1].index(n)
            if b - a >= line_words:
                out.append((a, b, ("line", tuple(low[a:b]))))
    return words, out


def brute(rows, min_words, line_words=None):
    """What is to be removed of ``rows`` (id, text), one row per id, and what is left of each text."""
    seen, runs, left = {}, [], {}
    for i, text in sorted(rows):
        text = text or ""
        words, units = units_of(text, line_words)
        mine, again = set(), []
        for a, b, what in units:
            if what in seen or what in mine:
                again.append((a, b, seen.get(what, i), len(what) == 2))
            mine.add(what)
        for what in mine:
            seen.setdefault(what, i)
        own = lambda x: x[3]
        pieces = [x for x in join([y for y in again if not own(y)]) if x[1] - x[0] >= min_words] + [x for x in again if own(x)]
        starts = [a for a, _ in words] + [len(text)]
        out, at = "", 0
        for a, b, keeper in join(sorted(x[:3] for x in pieces)):
            runs.append((i, starts[a], starts[b], b - a, keeper))
            out += text[at : starts[a]]
            at = starts[b]
        left[i] = out + text[at:]
    return sorted(runs), left


def join(pieces):
    out = []
    for a, b, keeper, *_ in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, keeper))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in ("ara", "on", "é", "um") for c in ("", "x", "Y")]
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randrange(2, 15))).capitalize() + r.choice([".", "!", "", "?"])
    passages = [r.choice([" ", "\n"]).join(sentence() for _ in range(8)) for _ in range(5)]
    out = []
    for i in range(80):
        parts = [sentence() for _ in range(r.randrange(0, 12))]
        if r.random() < 0.5:
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        if r.random() < 0.2:
            parts += parts[:3]
        out.append((i, r.choice([" ", "\n", "  ", " \n\n "]).join(parts)))
    return out + [(100, None), (101, ""), (102, "\n \n"), (103, "one " * 30000), (104, "One " * 30000 + "\n😀 Über. Ende"), (105, "line of its own\n" * 3), (106, " line  of its OWN"), (107, "x")]


def test_equals_brute_force(spark):
    for min_words, line_words in ((8, None), (20, None), (20, 3), (30, 1)):
        rows = corpus(min_words)
        df = spark.createDataFrame([(i, t, "x", 1, i) for i, t in rows], "doc_id long, text string, words string, removed int, id long").repartition(5)
        runs, left = brute(rows, min_words, line_words)
        spans = d.repeats(df, min_words=min_words, line_words=line_words)
        assert sorted(tuple(r)[:5] for r in spans.collect()) == runs
        for r in d.remove(df, spans).collect():
            assert (r.text or "") == left[r.doc_id]
            assert r.words == "x" and r.id == r.doc_id and (r.text is None) == (dict(rows)[r.doc_id] is None)


def test_passages_inside_sentences(spark):
    """A passage goes but for a few words at its ends, also where it begins, ends or is edited inside a sentence."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = [(1, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]))]
    for i in range(2, 40):
        text = [w.upper() if i % 3 == 0 else w for w in passage]
        if i % 4 == 0:
            text[30] = word()
        own = [[word() for _ in range(r.randrange(1, 60))] for _ in range(2)]
        rows.append((i, r.choice([" ", "\n", "  "]).join(own[0] + text + own[1])))
    clean = [(100 + i, " ".join(word().title() for _ in range(80))) for i in range(30)]
    df = spark.createDataFrame(rows + clean, "doc_id long, text string")
    gone = {}
    for x in d.repeats(df, line_words=d.LINE_WORDS).collect():
        gone[x.doc_id] = gone.get(x.doc_id, 0) + x.n_words
    assert set(gone) == set(range(2, 40))
    assert all(60 - 2 * (d.PICK - 1) * (1 + (i % 4 == 0)) - (i % 4 == 0) <= n <= 60 for i, n in gone.items())


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "Some words that are quite long and stand in more than one of these documents, to be found again here and there, and again. Then a second sentence, so that there are enough of them. "
    df = spark.createDataFrame([(1, text), (1, text), (2, "More before. " + text), (None, text), (None, text), (None, "Words of its own " * 9)], "doc_id long, text string")
    spans = d.repeats(df, line_words=d.LINE_WORDS)
    # of the nine copies of four words, stretches that begin a copy later are repeats
    assert sorted(str((r.doc_id, r.first_id)) for r in spans.collect()) == ["(2, 1)", "(None, 1)", "(None, 1)", "(None, None)"]
    left = sorted(str(r.text) for r in d.remove(df, spans).collect())
    assert left[:2] == ["", ""] and left.count(text) == 2 and left[2].startswith("More before. ") and len(left[2]) < 80
    assert left[-1].startswith("Words of its own Words") and left[-1].count("Words") < 5
    assert d.repeats(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r)[:5] for r in op5_line_dedup(spark, sf_dir).collect()) == brute(rows, d.MIN_WORDS, d.LINE_WORDS)[0]
