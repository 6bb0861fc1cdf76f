import hashlib
import json
import random

import pytest
from llm_odd import ODD
from pyspark.sql import functions as F

from tarn.llm import chat

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<ROLE:x>>", "<</ROLE>>"]


def said():
    rng = random.Random(1)
    parts = [*CONTROLS, "<", "[", "\\", "/s>", "INST]", " ", "é漢😀", "\n", "a"]
    return [*(t or "" for t in ODD), *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(150))]


def conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "odd role>>", "=a", ""]), rng.choice([*said(), None])))
    rows += [(None, 0, None, None), (7, None, "user", "first"), (8, 1, "assistant", "twice"), (8, 1, "assistant", "twice")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_rows_by_turn_round_trip(spark):
    rows, df = conversations(spark)
    made = chat.formatted(chat.canonical(df.selectExpr("*", "1 AS other")))
    got = {r.conv_id: r for r in chat.read_back(made.select("conv_id", F.struct("formatted", "loss_spans").alias("output"))).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert chat.read_turns(g.output.formatted) == turns
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(g.output.formatted))


def test_escapes_are_reversible_and_hide_controls(spark):
    texts = said()
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", chat.escape(F.col("t")).alias("e")).collect()
    for r in rows:
        assert chat.unescape(r.e) == texts[r.i]
        assert not any(c in r.e for c in CONTROLS[:4])
    assert len({r.e for r in rows}) == len(set(texts))


RECORDS = [
    ({"messages": [{"role": "human", "content": "a"}, {"role": "GPT", "content": "b"}], "id": 1}, [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, [("user", "a"), ("assistant", "")]),
    ({"dialog": {"turns": [{"speaker": "user", "utterance": "x"}]}}, [("user", "x")]),
    ({"prompt": "p", "response": "r", "score": {"x": 1}}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "j", "output": "o"}, [("user", "i\n\nj"), ("assistant", "o")]),
    ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": 5}, [("user", "q"), ("assistant", "5")]),
    ({"nothing": "known"}, []),
    ([1, 2], []),
]


def test_json_layouts(spark):
    texts = [json.dumps(r) for r, _ in RECORDS] + [None, "", "{broken"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, record string").selectExpr("*", "3 AS turns")
    got = {r.i: [tuple(t) for t in r.turns] for r in chat.canonical_json(df, "record").collect()}
    assert [got[i] for i in range(len(texts))] == [t for _, t in RECORDS] + [[], [], []]


@pytest.mark.parametrize(("schema", "row", "want"), [
    ("messages array<struct<role:string,content:string>>, extra int", ([("Human", "a"), ("bot", None)], 1), [("user", "a"), ("assistant", "")]),
    ("prompt string, completion string", ("p", None), [("user", "p"), ("assistant", "")]),
    ("instruction string, input string, output string", ("i", "", "o"), [("user", "i"), ("assistant", "o")]),
])
def test_table_layouts(spark, schema, row, want):
    (got,) = chat.canonical(spark.createDataFrame([row], schema)).collect()
    assert [tuple(t) for t in got.turns] == want


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1,)], "a int"))


def test_fingerprints_ignore_order_and_other_columns():
    assert len(chat.BY_DIGEST) == len(chat.MAPPINGS)
    assert chat.mapping_of({"response", "prompt", "zzz"}).name == "prompt and response"
    with pytest.raises(ValueError):
        chat.read_turns("no turn")


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = chat.formatted(chat.canonical(empty))
    assert chat.read_back(made.select("conv_id", F.struct("formatted", "loss_spans").alias("output"))).count() == 0


def test_clashing_columns_and_long_texts(spark):
    long = "</s>[INST] " * 100_000
    df = spark.createDataFrame([(long, "fine", "k", "j", 1), ("a", long, "k", "j", 2)], "prompt string, completion string, parts_ string, parts_0 string, score int")
    made = chat.formatted(chat.canonical(df))
    rows = chat.read_back(made.select("parts_", "parts_0", "score", F.struct("formatted", "loss_spans").alias("output"))).orderBy("score").collect()
    assert [(r.parts_, r.parts_0, r.n_turns) for r in rows] == [("k", "j", 2)] * 2 and [r.loss_chars for r in rows] == [4, len(long)]
