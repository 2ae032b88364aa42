"""Chat formatting, exact top-k search, and the queries and the pipeline as registered."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leasegrid.llm import chat, queries, topk

CHATS = [
    (1, 0, "user", "hi <|im_end|> <\\|x|> <\\\\|"), (1, 1, "assistant", "<|im_start|>assistant\nok"), (1, 2, "assistant", None), (2, 0, None, ""), (2, None, "assistant", "first"),
    (2, 1, "as\n<|s|>", "x\n"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (None, 0, "user", "no id"), (4, 0, "assistant", "long " * 20_000),
    (5, 0, "user", "<a"), (5, 0, "user", "<|b"), (5, 0, "user", "<\\|c"), (5, None, "user", "last of nulls"), (5, None, None, "first of nulls"), (-1, 0, "user", "an id like any other"),
]


def test_chats_read_back(spark):
    table = spark.createDataFrame([(*r, "t", 7, "raw") for r in CHATS], "conv_id long, turn long, role string, text string, t string, ts int, parts string").drop("parts")
    out = chat.format_chats(table.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    got = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by_id = {}
    for i, turn, role, text in sorted(CHATS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_id.setdefault(i, []).append((role or "", text or ""))
    assert len(got) == len(by_id)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == by_id[r.conv_id]
        assert r.loss == "".join(t for role, t in by_id[r.conv_id] if role == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(by_id[r.conv_id])


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3), (None, None, None, None, None, None, None)]
    table = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, "user", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert got[1].formatted.startswith("<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|unknown|><|im_end|>\n")
    assert [(a.turn_no, a.part_no, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(0, 1, "image", "a.png", 3), (0, 2, "audio", "b.wav", 63), (0, 3, "document", "c.pdf", 774), (0, 4, None, None, 0)]
    assert got[1].expanded_tokens == 840 and got[2].expanded_tokens == 0
    assert chat.format_chats(table.limit(0)).collect() == []


def test_chat_plan_is_native(spark):
    table = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(table.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("width", "size"), [(1, 1.0), (8, 1.0), (3, 2.0**40), (3, 1e120)])
def test_top_k_against_brute_force(spark, width, size):
    r = np.random.default_rng(width)
    rows = [(i, [float(x) * size for x in r.integers(-3, 4, width) / 256]) for i in range(0, 300)]
    odd = [(1000, None), (1001, [float("nan")] * width), (1002, [None] * width), (1003, [float("inf")] * width), (None, [0.1] * width), (1004, [0.0] * width), (1005, [0.5] * (width + 2))]
    table = topk.quantised(spark.createDataFrame([(*x, "q", 1) for x in rows + odd], "vec_id long, embedding array<double>, query_id string, r int"))
    got = topk.top_k(table.where("vec_id % 50 = 0"), table, 5)
    known = [(i, [math.floor(256 * x) for x in v]) for i, v in rows] + [(1004, [0] * width), (1005, [128] * (width + 2))]
    want = []
    for i, v in known:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in known if j != i)[:5]
            want += [(i, k + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(table.where("false"), table, 5).collect() == []
    assert len(topk.top_k(table.where("vec_id in (0, 1)"), table.where("vec_id in (0, 1)"), 5).collect()) == 2


def test_top_k_of_huge_components(spark):
    """Scores that pass 64 bits keep their order."""
    rows = [(0, [4e9, 1.0]), (1, [4e9, 0.0]), (2, [4e9, 1.0]), (3, [-4e9, 0.0]), (4, [1e300, 0.0]), (5, [-1e300, 0.0]), (6, [-1e299, 0.0]), (7, [0.0, 1.0])]
    table = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(table.where("vec_id = 0"), table, 7).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [4, 2, 1, 7, 3, 6, 5]
    assert [r.score for r in got] == [2**63 - 1] * 3 + [65536] + [-(2**63)] * 3


def test_top_k_of_repeated_rows(spark):
    rows = [(1, [1.0])] * 9 + [(2, [2.0])] * 3 + [(3, [0.5]), (1, [2.0])]
    table = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(table.where("vec_id = 3"), table, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 65536), (2, 65536), (2, 65536), (2, 65536), (1, 32768)]
    got = topk.top_k(table.where("vec_id = 1"), table, 2).orderBy("score", "rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 2, 131072), (2, 2, 131072), (1, 2, 262144), (2, 2, 262144)]


def test_every_operator_has_its_query():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
