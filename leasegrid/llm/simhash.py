"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint is posted under every choice of KEY of its 8 byte positions, with its bytes there. Two that
differ in at most BITS bits share at least 8 - BITS bytes, so they meet in at least LEAST_LISTS posting
lists. Pairs are tallied over the lists; those that reach this guaranteed minimum are verified.

A list sends on its pairs only while it is short. The members of a long one share KEY bytes already, and
two of them that are near share one more: they are posted again under KEY + 1 positions, where a list
has at most 65,536 members, which look up their neighbours. So no list emits all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, tidy

SEED, SHINGLE, BITS = 42, 3, 2
#: Positions of a key, and how many keys two fingerprints share that differ in BITS of 8 bytes.
KEY = 5
LEAST_LISTS = comb(8 - BITS, KEY)


def choices(n: int) -> list[tuple[int, ...]]:
    return list(combinations(range(8), n))


def masks_of(positions: list[tuple[int, ...]]) -> np.ndarray:
    return np.array([sum(0xFF << 8 * p for p in kept) for kept in positions], np.uint64)


KEYS, LONGER = choices(KEY), choices(KEY + 1)
MASKS, LONGER_MASKS = masks_of(KEYS), masks_of(LONGER)
#: The longer keys that hold each key.
ABOVE = [[k for k, more in enumerate(LONGER) if set(own) <= set(more)] for own in KEYS]
#: A longer list of postings is not paired but posted again.
SHORT = 16
#: The ways two 16-bit values can differ in 1 or 2 bits.
FLIPS = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], np.uint32)
SMALL = 128


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: each bit is 1 if over half of the shingles' hashes set it."""
    words = text.lower().split()  # of bytes: lower() takes A-Z alone, split() the blanks 20 and 09-0D
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    span = min(shingle, len(words)) - 1
    cuts = map(slice, (ends - lengths)[: len(words) - span].tolist(), ends[span:].tolist())
    n = len(words) - span
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row; null and blank texts have fp 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tidy()
            fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def posting_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is joined among the distinct fingerprints of one posting list.

    All of them share KEY + 1 = 6 bytes, so they are at most 65,536. Few are compared with each other; of many,
    each looks up the values 1 or 2 bits away among the two bytes that may differ.
    """
    label = np.arange(len(fps))
    if len(fps) <= SMALL:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= BITS
        step = lambda x: np.where(near, x[None, :], len(fps)).min(axis=1)
    else:
        by_byte = fps.view(np.uint8).reshape(-1, 8)
        differ = np.flatnonzero((by_byte != by_byte[0]).any(axis=0))
        rest = np.zeros(len(fps), np.uint32)
        for k, p in enumerate(differ):
            rest |= by_byte[:, p].astype(np.uint32) << np.uint32(8 * k)
        place = np.full(1 << 16, -1, np.int64)
        place[rest] = label

        def step(x: np.ndarray) -> np.ndarray:
            x = x.copy()
            for flip in FLIPS:
                other = place[rest ^ flip]
                np.minimum(x, np.where(other >= 0, x[other], len(fps)), out=x)
            return x

    while True:
        new = step(label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.arange(len(fps))
    linked = label != own
    return fps[label[linked]], fps[linked]


def posted(fps: DataFrame, masks: np.ndarray) -> DataFrame:
    """set, fp in order of set and the bytes that the set's mask keeps, like ones in one partition."""
    known = F.array(*[F.lit(int(m.view(np.int64))) for m in masks])
    rows = fps if "set" in fps.columns else fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("set"))
    rows = rows.select("set", F.col("fp").bitwiseAND(F.element_at(known, F.col("set") + 1)).alias("key"), "fp")
    return rows.repartition("set", "key").sortWithinPartitions("set", "key", "fp").select("set", "fp")


def lists_of(sets: np.ndarray, fps: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the posting lists start and end."""
    key = fps & masks[sets]
    new = np.flatnonzero((sets[1:] != sets[:-1]) | (key[1:] != key[:-1])) + 1
    return np.r_[0, new], np.r_[new, len(sets)]


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of short lists; and (fp, null, set) for each member of a long one."""
    sets, fps, long_ = np.zeros(0, np.int32), np.zeros(0, np.uint64), False

    def take(sets: np.ndarray, fps: np.ndarray, long_: bool) -> pa.RecordBatch:
        starts, ends = lists_of(sets, fps, MASKS)
        n = ends - starts
        if long_:  # the first list goes on from before
            n[0] += SHORT
        number, size = np.repeat(np.arange(len(n)), ends - starts), np.repeat(n, ends - starts)
        again = size > SHORT
        found = [np.zeros((0, 2), np.int64)]
        for gap in range(1, min(SHORT, int(n.max()))):
            at = np.flatnonzero((number[gap:] == number[:-gap]) & ~again[gap:])
            found.append(np.stack([fps[at], fps[at + gap]], 1).view(np.int64))
        pairs = np.concatenate(found)
        none = np.zeros(len(pairs), bool)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[pairs[:, 0], fps[again].view(np.int64)]),
                pa.array(np.r_[pairs[:, 1], np.zeros(again.sum(), np.int64)], mask=np.r_[none, np.ones(again.sum(), bool)]),
                pa.array(np.r_[np.zeros(len(pairs), np.int32), sets[again]]),
            ],
            ["a", "b", "set"],
        )

    for batch in batches:
        sets, fps = np.r_[sets, batch.column(0).to_numpy()], np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
        if not len(sets):
            continue
        starts, _ = lists_of(sets, fps, MASKS)
        last = int(starts[-1])  # this list may go on in the next batch
        if last:
            yield take(sets[:last], fps[:last], long_)
            sets, fps, long_ = sets[last:], fps[last:], False
        if len(sets) > SHORT:  # long already: what is here goes on, the last one shows the list to the next batch
            yield take(sets[:-1], fps[:-1], True)
            sets, fps, long_ = sets[-1:], fps[-1:], True
    if len(sets):
        yield take(sets, fps, long_)


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links inside each list of the longer keys."""
    sets, fps = np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def take(sets: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        found = [(np.zeros(0, np.uint64),) * 2]
        found += [posting_links(fps[s:e]) for s, e in zip(*lists_of(sets, fps, LONGER_MASKS), strict=True) if e - s > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], ["a", "b"])

    for batch in batches:
        sets, fps = np.r_[sets, batch.column(0).to_numpy()], np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
        if len(sets) and (last := int(lists_of(sets, fps, LONGER_MASKS)[0][-1])):
            yield take(sets[:last], fps[:last])
            sets, fps = sets[last:], fps[last:]
    if len(sets):
        yield take(sets, fps)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose closure joins exactly the distinct fp values at most BITS bits apart.

    A pair of which some list is long is found in that list's longer keys; of any other, all its lists
    are short, so its tally is whole.
    """
    sent = settled(posted(fps, MASKS).mapInArrow(tallied, "a long, b long, set int"))
    pairs = sent.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LISTS)
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    above = F.array(*[F.array(*map(F.lit, own)) for own in ABOVE])
    again = sent.where("b is null").select(F.col("a").alias("fp"), F.explode(F.element_at(above, F.col("set") + 1)).alias("set")).distinct()
    return near.unionByName(posted(again, LONGER_MASKS).mapInArrow(looked_up, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node and label, equal for nodes that links (a, b) join; only nodes with links are returned.

    Each round takes the least label among the neighbours, then the label of that label, so the
    number of rounds follows the logarithm of a component's diameter.
    """
    both = settled(edges.union(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = settled(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", F.least("label", "seen").alias("next"), F.col("label").alias("old"))
        new = settled(
            lower.join(labels.toDF("next", "beyond"), "next", "left")
            .select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), "old")
        )
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of at most 2 bits reach.

    Every row is kept, with all its columns' clashes avoided by returning these three alone. Null
    and blank texts have fingerprint zero and link like any other; texts of fewer words than a shingle
    are one; rows of equal text always share a component. Null ids stay null, and never name a
    component unless all its ids are null. An empty table gives no rows.
    """
    rows = settled(fingerprints(docs, id_col, text_col, shingle))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(distinct.select("fp")))
    classed = settled(distinct.join(labels.toDF("fp", "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(classed.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
