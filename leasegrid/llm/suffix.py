"""Suffix-array dedup: removes bytes that a 50-byte string of an earlier document covers.

A document's suffixes, cut to the match length, are its windows. Windows are put in suffix order only
where a match is possible, and only those of like content meet in one task:

1. Each window has a minimizer, the least hash of the shorter strings in it. Equal windows have equal
   minimizers, and neighbouring windows mostly share one, so a document falls into runs of windows.
2. Documents are dealt into blocks. Each block posts its minimizers, and learns which of them occur in
   two documents or more.
3. Runs with such a minimizer are sent, as text, to the bucket of the minimizer, once for each block
   and content. There the windows' suffix array is made; the previous and the next smaller document in
   suffix order give the longest previous factor of each window. Where it is as long as a match, the
   window is a later copy.
4. The covered spans return to their block, and are removed.

Hashes only say where to look: runs of a block count as one content, and windows as equal, if their
bytes are. The blocks' documents are shuffled once and read three times (a reused exchange).
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import CHUNK_BYTES, identities, mix, span_hashes, spans, tasks, texts_of, tidy

MATCH, GRAM = 50, 24
#: Text of a block, of a shard of minimizers and of a bucket, where the table is large.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 32 << 20
#: Blocks and shards of a small table, at most the shuffle's partitions.
LEAST_BLOCKS = 64
#: A minimizer of this many documents is split: its windows are sent one by one, each to its own bucket.
HEAVY = 1 << 15
#: What reaches a bucket is put in suffix order in so many parts, each of whole minimizers.
PARTS = 16
_ODD = 0x9E3779B97F4A7C15


def pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd").to_pybytes()


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd").to_pybytes())


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes (a multiple of 8) from each position on."""
    h, have = data.astype(np.uint64) + np.uint64(1), 1
    eight = None
    while have * 2 <= size:
        h = h[: len(h) - have] * np.uint64(pow(_ODD, have, 1 << 64)) + h[have:]
        have *= 2
        if have == 8:
            eight = h
    while have < size:
        h = h[: len(h) - 8] * np.uint64(pow(_ODD, 8, 1 << 64)) + eight[have : have + len(h) - 8]
        have += 8
    return mix(h)


def runs(data: np.ndarray, offsets: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, one past the last window, and minimizer of each run of windows that share it."""
    found = []
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        base, own = offsets[row], offsets[row : end + 1] - offsets[row]
        part = data[base : base + own[-1]]
        row = end
        if len(part) < match:
            continue
        least = sliding_min(gram_hashes(part, GRAM), match - GRAM + 1)
        valid = np.ones(len(least), bool)
        for cut in own[1:-1]:
            valid[max(0, cut - match + 1) : cut] = False
        edge = np.ones(len(least) + 1, bool)
        edge[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        edges = np.flatnonzero(edge)
        on = valid[edges[:-1]]
        found.append((edges[:-1][on] + base, edges[1:][on] + base, least[edges[:-1][on]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Block:
    """A block's rows in order of id and text, null ids last; rank is equal for equal ids."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").combine_chunks()
        text = table.column("text").to_pylist()
        known, values = ids.is_valid().to_pylist(), ids.to_pylist()
        self.order = sorted(range(len(text)), key=lambda i: (not known[i], values[i] if known[i] else 0, text[i] or ""))
        taken = ids.take(pa.array(self.order, pa.int64()))
        self.ids = np.asarray(taken.fill_null(0), np.int64)
        self.unknown = np.asarray(taken.is_null()).astype(np.uint8)
        self.rank = ranks(self.unknown, self.ids)
        self.data, self.offsets = texts_of(pa.array([text[i] for i in self.order], pa.large_string()))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first, last, key = runs(self.data, self.offsets)
        return first, last, key, np.searchsorted(self.offsets, first, "right") - 1


def ranks(unknown: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of the ids among the distinct ones, unknown ids after all others."""
    order = np.lexsort((ids, unknown))
    new = (np.diff(ids[order]) != 0) | (np.diff(unknown[order]) != 0)
    out = np.zeros(len(ids), np.int64)
    out[order[1:]] = np.cumsum(new)
    return out


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values together, and where each stretch of them starts."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    return order, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(values) else np.zeros(0, np.int64)


def post(shards: int):
    """Block -> its distinct minimizers and the number of ids with each, by shard."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tidy()
        block = Block(table)
        _, _, mins, row = block.runs()
        order, first = groups(mins)
        ids = block.rank[row[order]]
        # rows are in order of id, so within a stretch ids rise and change as often as there are more of them
        new = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
        new[first] = True
        distinct, n = mins[order][first], np.add.reduceat(new.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        shard = (distinct % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        used = np.flatnonzero(np.diff(cuts))
        blobs = []
        for k in used:
            own = by[cuts[k] : cuts[k + 1]]
            values = distinct[own]
            blobs.append(pack(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy(), np.minimum(n[own], 1 << 30).astype(np.uint32)))
        return pa.table({"shard": pa.array(used, pa.int64()), "b": pa.array([key[0].as_py()] * len(used), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def values_of(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def answer(heavy: int):
    """Shard -> for each block, which of its minimizers two ids or more have (1), which are heavy (2)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tidy()
        blocks = table.column("b").to_pylist()
        parts = [unpack(x) for x in table.column("blob").to_pylist()]
        values = [values_of(p) for p, _ in parts]
        every, n = np.concatenate(values), np.concatenate([c for _, c in parts]).astype(np.int64)
        order, first = groups(every)
        total = np.add.reduceat(n[order], first)
        mark = np.empty(len(every), np.uint8)
        mark[order] = np.repeat((total > 1) + (total > heavy).astype(np.int64), np.diff(np.r_[first, len(every)]))
        cuts = np.cumsum([0, *map(len, values)])
        blobs = [pack(mark[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"b": pa.array(blocks, pa.int64()), "shard": pa.array([key[0].as_py()] * len(blocks), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def send(shards: int, buckets: int):
    """Block and the marks of its minimizers -> texts of the runs that others may share, by bucket;
    in bucket -1 the runs that an earlier document of the block has too."""

    def run(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        tidy()
        b = key[0].as_py()
        out: list[tuple[int, bytes]] = []
        if table.num_rows and marks.num_rows:
            block = Block(table)
            first, last, mins, row = block.runs()
            distinct = np.unique(mins)
            shard = (distinct % np.uint64(shards)).astype(np.int64)
            mark = np.zeros(len(distinct), np.uint8)
            for s, blob in zip(marks.column("shard").to_pylist(), marks.column("blob").to_pylist(), strict=True):
                mark[shard == s] = unpack(blob)[0]
            mark = mark[np.searchsorted(distinct, mins)]
            shared = mark > 0
            first, last, row, bucket, mark = first[shared], last[shared], row[shared], mix(mins[shared]) % np.uint64(PARTS * buckets), mark[shared]
            split = mark > 1
            if split.any():  # window by window
                n = (last - first)[split]
                window = np.repeat(first[split] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                home = span_hashes(block.data, window, window + MATCH) % np.uint64(PARTS * buckets)
                first, last, row = np.r_[first[~split], window], np.r_[last[~split], window + 1], np.r_[row[~split], np.repeat(row[split], n)]
                bucket = np.r_[bucket[~split], home]
            end = last + MATCH - 1
            # Of runs with one content, those of the smallest id stand for all.
            _, content = identities(block.data, first, end)
            least = np.full(content.max() + 1 if len(content) else 0, len(block.rank), np.int64)
            np.minimum.at(least, content, block.rank[row])
            later = block.rank[row] > least[content]
            begin = first - block.offsets[row]
            if later.any():
                out.append((-1, pack(row[later].astype(np.int32), begin[later].astype(np.int32), (begin + end - first)[later].astype(np.int32))))
            keep = np.flatnonzero(~later)
            keep = keep[np.argsort(bucket[keep], kind="stable")]
            used, cut = np.unique(bucket[keep] // np.uint64(PARTS), return_index=True)
            for k, s, e in zip(used.tolist(), cut.tolist(), [*cut[1:].tolist(), len(keep)][: len(used)], strict=True):
                own = keep[s:e]
                text = np.concatenate([block.data[x:y] for x, y in zip(first[own].tolist(), end[own].tolist(), strict=True)])
                out.append((k, pack((bucket[own] % np.uint64(PARTS)).astype(np.uint8), block.unknown[row[own]], block.ids[row[own]], row[own].astype(np.int32), begin[own].astype(np.int32), (end - first)[own].astype(np.int32), text)))
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int64()), "b": pa.array([b] * len(out), pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    return run


def words_at(data: np.ndarray, at: np.ndarray, match: int) -> tuple[list[int], list[np.ndarray]]:
    """The match bytes from each place as numbers that sort as the bytes do, and where each number starts."""
    eights = np.ndarray(max(0, len(data) - 7), ">u8", np.ascontiguousarray(data), strides=(1,))
    steps = [*range(0, match - 7, 8)]
    if steps[-1] + 8 < match:
        steps.append(match - 8)
    return steps, [eights[at + k].astype(np.uint64) for k in steps]


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """The nearest place before each one that holds a smaller value, -1 where none does: up a tree of
    minima to the first subtree on the left that holds one, and down to its last such place."""
    levels = [x]
    while len(levels[-1]) > 1:
        y = levels[-1] if len(levels[-1]) % 2 == 0 else np.r_[levels[-1], np.iinfo(x.dtype).max]
        levels.append(np.minimum(y[::2], y[1::2]))
    out = np.full(len(x), -1, np.int64)
    who, node, met = np.arange(len(x)), np.arange(len(x)), []
    for level in levels[:-1]:
        hit = np.zeros(len(who), bool)
        odd = np.flatnonzero(node & 1)
        hit[odd] = level[node[odd] - 1] < x[who[odd]]
        met.append((who[hit], node[hit] - 1))
        who, node = who[~hit], node[~hit] >> 1
    who, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(len(met) - 1, -1, -1):
        who, node = np.r_[who, met[k][0]], np.r_[node, met[k][1]]
        if k:
            right = np.minimum(2 * node + 1, len(levels[k - 1]) - 1)
            node = np.where(levels[k - 1][right] < x[who], right, 2 * node)
    out[who] = node
    return out


def common_prefix(steps: list[int], words: list[np.ndarray], left: np.ndarray, right: np.ndarray, match: int) -> np.ndarray:
    """How many of their match bytes the windows of both lists share at the start."""
    start = np.full(len(left), match, np.int64)
    differ = np.zeros(len(left), np.uint64)
    for step, word in zip(steps[::-1], words[::-1], strict=True):
        x = word[left] ^ word[right]
        other = x != 0
        start[other], differ[other] = step, x[other]
    for k in range(1, 8):  # a leading byte without a difference counts on
        start += (differ != 0) & (differ < np.uint64(1 << 8 * (8 - k)))
    return start


def longest_previous(data: np.ndarray, windows: np.ndarray, rank: np.ndarray, match: int = MATCH) -> np.ndarray:
    """The longest-previous-factor array: how many bytes of each window, match at most, another window
    of a smaller rank starts with.

    Windows are put in suffix order, cut at match bytes. In that order the nearest window on either side
    with a smaller rank shares the most with it, so the longer of both common prefixes is the factor.
    """
    if not len(windows):
        return np.zeros(0, np.int64)
    order = np.argsort(np.ndarray(len(data) - match + 1, f"S{match}", np.ascontiguousarray(data), strides=(1,))[windows])
    steps, words = words_at(data, windows[order], match)
    x = rank[order]
    here = np.arange(len(order))
    best = np.zeros(len(order), np.int64)
    for near in (previous_smaller(x), len(x) - 1 - previous_smaller(x[::-1])[::-1]):
        at = np.flatnonzero((near >= 0) & (near < len(x)))
        best[at] = np.maximum(best[at], common_prefix(steps, words, here[at], near[at], match))
    out = np.empty(len(order), np.int64)
    out[order] = best
    return out


def compare(key: tuple, table: pa.Table) -> pa.Table:
    """Bucket -> for each block, the spans (row, start, end) that earlier documents cover."""
    tidy()
    if key[0].as_py() < 0:
        return table.select(["b", "blob"])
    blocks = table.column("b").to_pylist()
    parts = [unpack(x) for x in table.column("blob").to_pylist()]
    part, unknown, ids, row, begin, length, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    rank = ranks(unknown, ids)
    block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    length = length.astype(np.int64)
    at = np.cumsum(length) - length
    found = []
    for k in range(PARTS):
        some = np.flatnonzero(part == k)
        n = length[some] - MATCH + 1
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run = np.repeat(some, n)
        covered = longest_previous(text, at[run] + place, rank[run]) >= MATCH
        starts, ends = spans(covered, np.r_[0, np.cumsum(n)])
        found.append((run[starts], place[starts], ends - starts))
    own, place, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(own, kind="stable")  # blocks in order again
    own = own[order]
    s = begin[own] + place[order]
    e = s + n[order] + MATCH - 1
    cuts = np.searchsorted(block[own], np.arange(len(parts) + 1))
    used = np.flatnonzero(np.diff(cuts))
    blobs = [pack(row[own[cuts[k] : cuts[k + 1]]], s[cuts[k] : cuts[k + 1]].astype(np.int32), e[cuts[k] : cuts[k + 1]].astype(np.int32)) for k in used]
    return pa.table({"b": pa.array([blocks[k] for k in used], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def remove(carried: list[str], as_text: bool):
    """Block and covered spans -> each row's removed spans and what is left of its bytes."""

    def run(key: tuple, table: pa.Table, covered: pa.Table) -> pa.Table:
        tidy()
        block = Block(table)
        delta = np.zeros(len(block.data) + 1, np.int32)
        for blob in covered.column("blob").to_pylist():
            row, s, e = unpack(blob)
            base = block.offsets[row]
            np.add.at(delta, base + s, 1)
            np.add.at(delta, base + e, -1)
        gone = np.cumsum(delta[:-1]) > 0
        starts, ends = spans(gone, block.offsets)
        row = np.searchsorted(block.offsets, starts, "right") - 1
        left = block.data[~gone].tobytes()
        bound = np.r_[0, np.cumsum(~gone)][block.offsets].tolist()
        kept = [left[s:e] for s, e in zip(bound[:-1], bound[1:], strict=True)]
        relative = np.stack([starts, ends], 1) - block.offsets[row][:, None]
        cuts = np.searchsorted(row, np.arange(len(block.ids) + 1))
        own = {
            "doc_id": table.column("doc_id").take(pa.array(block.order, pa.int64())),
            "n_bytes": pa.array(np.diff(block.offsets)),
            "removed": pa.ListArray.from_arrays(pa.array((2 * cuts).astype(np.int32)), pa.array(relative.ravel())),
            "kept": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
        }
        others = table.select(carried).take(pa.array(block.order, pa.int64()))
        return pa.table(own | {c: others.column(c) for c in carried})

    return run


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, removed and kept of every row: removed lists start and end of the maximal runs
    of bytes that a 50-byte string covers which also starts in a row with a smaller id; kept is the
    remaining bytes, or with as_text the whole characters among them. carry names one more column to return.

    Strings are judged on the input, so the first copy stays whole. Null texts are empty and texts
    under 50 bytes lose nothing. Rows of one id do not remove from each other; a null id is larger
    than all others. Ids are whole numbers of any kind up to 64 bits and return as they came; other
    kinds are refused. An empty table gives no rows.
    """
    spark = docs.sparkSession
    carried = [] if carry is None else ["carried"]
    kind = docs.select(id_col).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} has to be a whole number, not {kind.simpleString()}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(carry).alias("carried")] if carried else []))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = min(tasks(spark), LEAST_BLOCKS)
    blocks, shards = max(least, -(-size // block_bytes)), max(least, -(-size // (SHARD_BYTES * block_bytes // BLOCK_BYTES)))
    # Repeated rows are dealt by where they come from, so that no block has to hold all of them.
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)))
    by_block = rows.groupBy("b")
    posted = by_block.applyInArrow(post(shards), "shard long, b long, blob binary")
    marks = posted.groupBy("shard").applyInArrow(answer(heavy), "b long, shard long, blob binary")
    sent = by_block.cogroup(marks.groupBy("b")).applyInArrow(send(shards, shards), "bucket long, b long, blob binary")
    # What needs no comparing is dealt by block, as if each block had a bucket of its own for it.
    sent = sent.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.col("b")).otherwise(F.col("bucket")))
    covered = sent.groupBy("bucket").applyInArrow(compare, "b long, blob binary")
    schema = f"doc_id long, n_bytes long, removed array<long>, kept {'string' if as_text else 'binary'}"
    if carried:
        schema += f", carried {rows.schema['carried'].dataType.simpleString()}"
    return by_block.cogroup(covered.groupBy("b")).applyInArrow(remove(carried, as_text), schema)
