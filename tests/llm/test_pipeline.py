"""The pipeline against the same stages by hand, and every registered query of the operators."""

import hashlib
import importlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from leasegrid.llm import langid, lm, queries
from tests.llm.test_text_operators import dedup_by_hand, lowered, out_of_place, simhash_by_hand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, key string, row string"


def pipeline():
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline here")
    return importlib.import_module("corpus_pipeline")


def documents():
    r = random.Random(12)
    v = {a: ["".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(300)] for a in ("abcdefgh", "stuvwxyz")}
    say = lambda n, a="abcdefgh": " ".join(r.choice(v[a]) for _ in range(n))
    item = " ".join(f"item{k}" for k in range(14))
    shared = say(20)
    own = [(say(r.randint(20, 120)), "aa") for _ in range(30)] + [(say(r.randint(20, 120), "stuvwxyz"), "ss") for _ in range(20)]
    own += [(f"{say(25)} {shared} {say(25)}", "aa") for _ in range(4)] + [(f"{say(15)} {item} {say(5)}", "aa"), (say(3000), "aa"), (say(30), None), (say(40, "жщэю") if "жщэю" in v else "жщэю эюжщ " * 30, None)]
    own += [(own[2][0], "aa"), (own[2][0], "aa"), (own[3][0] + " end", "aa"), (own[55][0] + " end", "aa"), (None, "aa"), (None, None), ("", "aa"), ("12 !!", "aa"), ("x", "aa"), (shared, None)]
    rows = [(i * 7 % 97 if i != 9 else None, t, lang, "s", len(t or ""), "key", f"row {i}") for i, (t, lang) in enumerate(own)]
    return [*rows, rows[5], (*rows[5][:6], "a row that comes first"), (2**53 + 1, own[7][0], "aa", "s", 1, "key", "big")], item


def order_of(i):
    return (i is None, i or 0)


def by_hand(rows, item):
    """doc_id and text after each of the first four stages, in order."""
    learned = {a: [t for _, t, lang, *_ in rows if lang == a and t is not None] for a in ("aa", "ss")}

    def accepted(text):
        n = len(langid.ranked(*langid.grams(text or ""), langid.PROFILE))
        if not n:
            return False
        best = max(1 - d / m for d, m in (out_of_place(text, own, langid.PROFILE) for own in learned.values()))
        return n < langid.LEAST_GRAMS or best >= langid.LEAST_SCORE

    kept = [r[:2] for r in rows if accepted(r[1])]
    stages = [kept]
    distinct = sorted(set(kept), key=lambda r: (order_of(r[0]), r[1]))
    fps, root = [simhash_by_hand(t) for _, t in distinct], list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    stages.append([r for k, r in enumerate(distinct) if find(k) == k])
    left = [(i, b.decode("utf-8", "ignore")) for i, _, _, b in dedup_by_hand(stages[-1])]
    stages.append([(i, t) for i, t in left if t])
    words = item.split()
    windows = {" ".join(words[k : k + 10]) for k in range(len(words) - 9)}
    stages.append([(i, t) for i, t in stages[-1] if not any(f" {w} " in f" {lowered(t)} " for w in windows)])
    return stages


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_equals_its_stages_by_hand(spark, tmp_path, empty):
    from tokenizers import Tokenizer

    module = pipeline()
    rows, item = documents()
    rows = [] if empty else rows
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = by_hand(rows, item)
    if not empty:
        assert len({len(x) for x in want}) == 4  # each stage decides something
    known = {(r[0], r[1]): r for r in sorted(rows, key=lambda r: r[6], reverse=True)}
    for (name, stage), own in zip(module.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, folder)
        assert out.schema == docs.schema
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        got = docs.collect()
        assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted(own, key=repr), name
        if name == "near_duplicates":
            assert sorted([r.row for r in got]) == sorted(known[i, t][6] for i, t in own)
        if name in ("repeats", "benchmark_free"):
            assert all(r.n_chars == len(r.text) for r in got)
        assert all(r.lang in ("aa", "ss") and r.source == "s" and r.key == "key" for r in got)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = []
    for i, t in want[-1]:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = module.run(spark, folder).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(pieces, key=repr)
    assert empty or max(p[1] for p in pieces) >= 1
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048


def test_every_operator_has_its_query():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_op2_query(spark, texts):
    got = queries.op2_packing(spark, SF).collect()
    assert Counter(r.doc_id for r in got).keys() == texts.keys()
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 2048) + 3 and max(r.offset + r.length for r in got) <= 2048


def test_op5_query(spark, texts):
    got = queries.op5_language(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: crc(i) % 5 == 0 for i in texts}
    held = [r for r in got if r.held_out and texts[r.doc_id].lang]
    assert sum(r.lang_pred == texts[r.doc_id].lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_op6_query(spark, texts):
    from tests.llm.test_text_operators import lm_by_hand

    rows = [(i, r.text) for i, r in texts.items()]
    want = {x[0]: x for x in lm_by_hand(rows, lambda i: crc(i) % 7 != 2, lm.ORDER)}
    for r in queries.op6_lm(spark, SF).collect():
        x = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*x[1:4], crc(r.doc_id) % 7 == 2)
        assert r.base_score == pytest.approx(x[4], rel=1e-9) and r.score == pytest.approx(x[5], abs=x[1] * lm.ORDER / lm.STEP)


def test_op7_query(spark, texts):
    got = queries.op7_simhash(spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{simhash_by_hand(t.text):016x}" for i, t in texts.items()}
    assert all(r.component_id <= r.doc_id for r in got)


def test_op8_query(spark, texts):
    got = queries.op8_shards(spark, SF).collect()
    data = {i: (r.text or "").encode() for i, r in texts.items()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(b) + 8, zlib.crc32(b)) for i, b in data.items()}
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(24))


def test_op9_query(spark, texts):
    want = [(i, n, n - len(b), k, hashlib.sha256(b).hexdigest()) for i, n, k, b in dedup_by_hand([(i, r.text) for i, r in texts.items()])]
    assert sorted(map(tuple, queries.op9_suffix(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == sorted(want)


def test_op10_query(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op10_quality(spark, folder).collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.95
