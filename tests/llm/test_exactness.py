"""Exact identity: ids keep all their bits, and equal hashes alone never make texts equal."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leasegrid.llm import common, decontaminate, lm, packing, suffix
from leasegrid.llm.queries import tokenizer_path


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


TWINS = (thue_morse(2048), thue_morse(2048, "b", "a"))


def same_hash(data, starts, ends):
    return np.zeros(len(starts), np.uint64)


@pytest.mark.parametrize("hashes", [common.span_hashes, same_hash])
def test_identities_follow_the_bytes(monkeypatch, hashes):
    monkeypatch.setattr(common, "span_hashes", hashes)
    words = [b"", b"a", b"a\0", b"abcdefgh", b"abcdefgi", b"x" * 500, b"x" * 499 + b"y", *[t.encode() for t in TWINS], b"a", b"", b"x" * 500]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    first, number = common.identities(data, ends - [len(w) for w in words], ends)
    assert [words[first[k]] for k in number] == words and len(first) == len(set(words))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 333])
@pytest.mark.parametrize("values", [1, 3, 1000])
def test_previous_smaller(n, values):
    x = np.random.default_rng(n).integers(0, values, n)
    assert suffix.previous_smaller(x).tolist() == [max([j for j in range(i) if x[j] < x[i]], default=-1) for i in range(n)]


@pytest.mark.parametrize("letters", [[97, 98], [0, 255], [97]])
def test_longest_previous_factors(letters):
    r = np.random.default_rng(len(letters))
    data = r.choice(np.array(letters, np.uint8), 500)
    data[200:300] = data[:100]
    windows, rank = np.sort(r.choice(450, 300, replace=False)), r.integers(0, 20, 300)

    def shared(a, b):
        k = 0
        while k < 50 and data[a + k] == data[b + k]:
            k += 1
        return k

    want = [max([shared(a, b) for b, q in zip(windows, rank) if q < p], default=0) for a, p in zip(windows, rank)]
    assert suffix.longest_previous(data, windows, rank).tolist() == want


def test_suffix_dedup_keeps_ids_whole(spark):
    text = "A line of text that is well over fifty bytes long, and the same in every document."
    ids = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), None, 2**63 - 1]
    docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    got = [(r.doc_id, bytes(r.kept) == b"") for r in suffix.dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted([(i, i != -(2**63)) for i in ids], key=repr)
    last = suffix.dedup(docs.where("doc_id = 9223372036854775807 or doc_id is null")).collect()
    assert sorted([(r.doc_id is None, len(r.kept) > 0) for r in last]) == [(False, True), (False, True), (True, False)]
    with pytest.raises(TypeError):
        suffix.dedup(docs.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_suffix_dedup_compares_long_twins(spark):
    docs = spark.createDataFrame(list(enumerate([TWINS[0], TWINS[1], TWINS[0]])), "doc_id long, text string")
    seen, want = {}, []
    for i, t in enumerate([TWINS[0], TWINS[1], TWINS[0]]):
        gone = {k + j for k in range(len(t) - 49) if seen.get(t[k : k + 50], i) < i for j in range(50)}
        for k in range(len(t) - 49):
            seen.setdefault(t[k : k + 50], i)
        want.append((i, len(t) - len(gone)))
    assert sorted((r.doc_id, len(r.kept)) for r in suffix.dedup(docs).collect()) == want


def test_decontamination_compares_long_twins(spark):
    docs = spark.createDataFrame([(2**53 + 1, f"see {TWINS[0]} here"), (None, f"see {TWINS[1]} here"), (2**63 - 1, f"{TWINS[1].upper()}!")], "doc_id long, text string")
    items = spark.createDataFrame([(2**53 + 3, TWINS[1])], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.hits, r["items"]) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {2**53 + 1: (3, [], []), None: (3, [1, 2], [str(2**53 + 3)]), 2**63 - 1: (1, [0, 1], [str(2**53 + 3)])}


@pytest.mark.parametrize("hashes", [common.span_hashes, same_hash])
def test_windows_with_equal_hashes_are_told_apart(monkeypatch, hashes):
    monkeypatch.setattr(common, "span_hashes", hashes)
    monkeypatch.setattr(decontaminate, "span_hashes", hashes)
    index = decontaminate.Windows([("x", "one two three"), ("y", "one two four"), ("z", "One, two. FOUR five"), ("w", "")], 3)
    index.order({})
    words = decontaminate.Words(pa.array(["so one two four it is", None, "one two", "two four five"]))
    found = {(int(b), name) for b, w in zip(*index.find(words), strict=True) for name in index.owned_by(w)}
    assert found == {(1, "y"), (1, "z"), (8, "z")}


def test_packing_and_scores_tell_long_twins_apart(spark):
    texts = [TWINS[0], TWINS[1], f"{TWINS[0]} {TWINS[1]} {TWINS[0]}"]
    docs = spark.createDataFrame([(2**53 + 1 + i, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r.ids_crc32 for r in packing.pieces(docs, tokenizer_path(), 1 << 20).collect()}
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert got == {**{2**53 + 1 + i: crc(t) for i, t in enumerate(texts)}, None: crc("x")}
    known = {r.doc_id: r.n_known for r in lm.score(docs, F.col("doc_id") == 2**53 + 1).collect()}
    assert known == {2**53 + 1: 2, 2**53 + 2: 1, 2**53 + 3: 3, None: 1}


def test_scores_with_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "span_hashes", same_hash)
    table = pa.table({"slice": [0, 0], "block": [1, 2], "level": [1, 1], "a": [lm.squeeze(np.array([1, 3, 2])), lm.squeeze(np.array([2, 1]))], "b": [b"aabcde", b"dea"], "c": [lm.squeeze(np.array([5, 1, 2])), lm.squeeze(np.array([7, 4]))]})
    rows = {r[1]: [r[3].tolist(), *[np.cumsum(x).tolist() for x in r[4:]]] for r in lm.counted_words(table, 10)}
    assert rows[1][0] == [9, 1, 9] and rows[2][0] == [9, 9]  # a, abc, de; de, a
    assert rows[1][1][2] == rows[2][1][0] and rows[1][1][0] == rows[2][1][1] and len(set(rows[1][1])) == 3
    assert rows[-1] == [[19, 3]]
