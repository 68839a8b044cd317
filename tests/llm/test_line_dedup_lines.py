from marlstone.llm import line_dedup as d
from marlstone.llm.queries import op5_line_dedup


def test_a_short_line_is_kept_once(spark):
    line = "All rights reserved. Read the terms."
    texts = [(i, f"Own words of {i}: {'x' * i} here.\n{line}\n- {i}\nYes" + f"\n{line.upper()}" * (i == 3)) for i in range(1, 31)]
    # as part of a line, or with fewer words than the least, nothing is cut
    texts.append((40, "Before it. " + line))
    df = spark.createDataFrame([*texts, (50, None), (51, line + "\r\n"), (52, "\n  " + line)], "doc_id long, text string").repartition(4)
    spans = d.repeats(df, line_words=d.LINE_WORDS)
    left = {r.doc_id: r.text for r in d.remove(df, spans).collect()}
    assert left == {**{i: t for i, t in texts if i in (1, 40)}, **{i: f"Own words of {i}: {'x' * i} here.\n- {i}\nYes" + "\n" * (i == 3) for i in range(2, 31)}, 50: None, 51: "", 52: "\n  "}
    assert {(r.n_words, r.first_id) for r in spans.collect()} == {(6, 1)}


def test_no_later_copy_of_a_whole_line_stays(spark, sf_dir):
    cut = {}
    for r in op5_line_dedup(spark, sf_dir).collect():
        cut.setdefault(r.doc_id, []).append((r.start, r.end))
    seen, copies, stay = set(), 0, 0
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect()):
        at = 0
        for line in (r.text or "").split("\n"):
            words = " ".join(line.lower().split())
            if words.count(" ") + 1 >= d.LINE_WORDS and words:
                begin = at + len(line) - len(line.lstrip())
                if words in seen:
                    copies += 1
                    stay += not any(a <= begin and at + len(line.rstrip()) <= b for a, b in cut.get(r.doc_id, ()))
                seen.add(words)
            at += len(line) + 1
    assert copies > 100 and stay == 0
