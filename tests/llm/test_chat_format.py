import hashlib
import json
from collections import defaultdict

from pyspark.sql import functions as F

from marlstone.llm import chat_format as c
from marlstone.llm.queries import op1_chat_format

NASTY = ["", "\\", "###", "### user: x</turn>\n", "\\### Assistant: </turn> ok", "####", "\\h\\e\\b", "</turn", "a: b\nc: d", "😀 é" * 500, "x" * 200000]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_layouts_become_canonical_turns(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    records = {
        "prompt_completion": {"prompt": "hi", "completion": "yo"}, "prompt_response": {"response": "yo", "prompt": "hi"}, "instruction": {"instruction": "hi", "output": "yo"},
        "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "conversations": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        "turns": {"turns": [{"role": "user", "text": "hi"}, {"text": "yo", "role": "assistant"}]},
    }
    odd = {"nothing": {"x": 1}, "list": [1, 2], "extra": {"prompt": "a", "completion": "b", "more": 1}}
    rows = [(k, json.dumps(v)) for k, v in {**records, **odd}.items()] + [("null", None)]
    df = spark.createDataFrame(rows, "name string, layout string")
    got = {r.name: r for r in c.canonical_turns(df, F.try_parse_json("layout")).collect()}
    assert len(got) == len(rows)
    for name in records:
        assert got[name].layout == name and [tuple(t) for t in got[name].turns] == want
    for name in ("nothing", "list", "extra", "null"):
        assert got[name].layout is None and got[name].turns == []
    both = spark.createDataFrame([(json.dumps({"instruction": "a", "input": "b", "output": None}),), (json.dumps({"system": "s", "prompt": "p", "response": "r"}),)], "j string")
    assert [[tuple(t) for t in r.turns] for r in c.canonical_turns(both, F.parse_json("j")).collect()] == [[("user", "a\n\nb"), ("assistant", "")], [("system", "s"), ("user", "p"), ("assistant", "r")]]


def test_other_columns_are_kept_whatever_their_names(spark):
    df = spark.createDataFrame([(1, "own r", "p", "old", "user", "hi " * 100_000, 5)], "conv_id long, r string, `print` string, turns string, role string, text string, `odd ``name` int")
    got = c.canonical_turns(df, F.to_variant_object(F.struct("role", "text"))).first()
    assert (got.r, got["print"], got.role, got["odd `name"]) == ("own r", "p", "user", 5) and [tuple(t) for t in got.turns] == [("user", "hi " * 100_000)]


def test_control_strings_round_trip(spark):
    rows = [(i // 3, i % 3, role, t) for i, (role, t) in enumerate((r, t) for t in NASTY for r in ("user", "assistant", "odd: ### \\role"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    done = c.format_conversations(c.canonical_turns(df, F.to_variant_object(F.struct("role", "text"))))
    got = done.select("conv_id", c.parse_formatted(F.col("formatted")).alias("t"), c.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), "formatted").collect()
    assert len(got) == len(NASTY)
    for r in got:
        mine = [(role, t) for i, _, role, t in rows if i == r.conv_id]
        assert [tuple(t) for t in r.t] == mine and r.loss == mine[1][1]
        assert r.formatted.count("</turn>") == 3


def test_ties_nulls_repeated_rows_and_no_rows(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, "assistant", None), (1, 0, None, "z"), (None, 0, "user", "q"), (1, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    turns = c.canonical_turns(df, F.to_variant_object(F.struct("role", "text")))
    got = {r.conv_id: [tuple(t) for t in r.t] for r in c.format_conversations(turns).select("conv_id", c.parse_formatted(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("assistant", ""), ("", "z"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", "q")]}
    assert c.format_conversations(turns.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    got = op1_chat_format(spark, sf_dir).collect()
    assert len(got) == len(convs)
    for r in got:
        turns = [(role, t) for _, role, t in sorted(convs[r.conv_id])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
