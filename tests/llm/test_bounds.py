"""Bounds that operators state: sequences against sequential best fit, rows of a sample, shards of many rows."""

import bisect
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leasegrid.llm import packing, quality, sharding


def best_fit_decreasing(sizes, capacity):
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, opened = capacity, opened + 1
        if gap > size:
            bisect.insort(gaps, gap - size)
    return opened


RNG = random.Random(11)
SIZES = {
    "alike, three to a sequence": [RNG.randint(600, 760) for _ in range(6000)],
    "three to five": [RNG.randint(350, 680) for _ in range(6000)],
    "ten": [RNG.randint(160, 250) for _ in range(9000)],
    "any": [RNG.randint(1, 2048) for _ in range(6000)],
    "log-normal": [min(2048, int(RNG.lognormvariate(5, 1)) + 1) for _ in range(30_000)],
}


@pytest.mark.parametrize("sizes", SIZES.values(), ids=SIZES)
def test_packing_is_that_of_sequential_best_fit(spark, sizes):
    rows = packing.pack(spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "id int, length int")).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.id for r in rows) == list(range(len(sizes)))
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.005 * best_fit_decreasing(sizes, 2048)


def test_packing_of_lengths_without_tokens(spark):
    rows = packing.pack(spark.createDataFrame([(k, s) for k, s in enumerate([None, 0, 0, 3, 2048, 5000, None])], "id int, length int"), 2048).collect()
    assert sorted(r.id for r in rows) == list(range(7)) and all(r.sequence_id is not None for r in rows)
    assert len({r.sequence_id for r in rows if r.length}) == 3


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    docs = spark.range(500).select((F.col("id") % 5).alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)] * 2, "doc_id long, quality int")
    fitted = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda vectors, x, y: (fitted.append(len(x)), train(vectors, x, y))[1])
    quality.fit(docs, labels, sample_rows=5)
    quality.fit(docs, labels, sample_rows=700)
    assert fitted == [5, 500]


def test_shards_of_many_rows(spark):
    """More rows than make every group hot, so that groups also meet their rows in a shuffle."""
    rng = random.Random(4)
    texts = ["copy " * rng.randint(1, 40) if k % 9 == 0 else f"{k} " * rng.randint(1, 90) for k in range(3000)] + ["hot"] * 800 + [None, ""]
    rows = [(k if k % 700 else None, t) for k, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    sizes, slots, shards_of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    known = {k: t for k, t in rows if k is not None}
    for r in got:
        if r.doc_id is not None:
            text = (known[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
            shards_of[text].add(r.shard)
    assert len(got) == len(rows) and set(sizes) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards_of.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * max(sizes.values())


def test_one_digest_drops_no_text(spark, tmp_path, monkeypatch):
    """With every digest equal, rows that are no copies of each other stay."""
    monkeypatch.setattr(corpus_pipeline.F, "sha2", lambda *c: F.lit("same"))
    docs = spark.createDataFrame([(1, "ein Haus am See und ein Baum", "de", "s", 1), (1, "quite another text of other words", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert {r.text for r in got} == {r.text for r in docs.collect()}
