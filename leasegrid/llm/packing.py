"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, chunks, identities, resident, row_of, settled, texts_of, tidy

SEQUENCE, END_ID = 2048, 0
#: Parts that a worker keeps the ids of; when it has more, it keeps those that came again.
CACHE_ENTRIES = 1 << 19

# Where a text may be cut before tokenising: by the class of the byte before and after.
_LETTER, _OTHER, _QUOTE, _HIGH, _BLANK = range(5)
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[65:91] = CLASS[97:123] = _LETTER
CLASS[39], CLASS[128:] = _QUOTE, _HIGH
CLASS[BLANK] = _BLANK
CUT = np.zeros((5, 5), bool)
CUT[_BLANK, :4] = CUT[:4, _BLANK] = True
CUT[_LETTER, [_OTHER, _QUOTE]] = CUT[_OTHER, _LETTER] = True


class Tokens:
    """Token ids of word pieces, each encoded once and kept.

    The tokenizer splits at white space and between ASCII letters and other ASCII characters (except
    after an apostrophe), so ids of the parts, in order, are the ids of the text. Parts with other
    characters are left whole between blanks.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.seen = np.zeros(0, np.int32)

    def keep_frequent(self) -> None:
        """Forgets all parts but those that came in the most chunks, half as many as there may be at most."""
        floor = 2
        while np.count_nonzero(self.seen >= floor) > CACHE_ENTRIES // 2:
            floor += 1
        kept = np.flatnonzero(self.seen >= floor)
        parts, n = list(self.known), self.count[kept]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.first[kept] - (ends - n), n) + np.arange(int(n.sum()))]
        self.known = {parts[k]: i for i, k in enumerate(kept.tolist())}
        self.first, self.count, self.ids, self.used = ends - n, n, ids, len(ids)
        self.seen = np.zeros(len(kept), np.int32)

    def learn(self, parts: list[bytes]) -> None:
        """Adds parts, which are new."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        new = np.fromiter((i for x in lists for i in x), np.uint32, int(n.sum()))
        while self.used + len(new) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(len(self.ids), 1 << 16), np.uint32)]
        self.ids[self.used : self.used + len(new)] = new
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.first = np.r_[self.first, self.used + np.cumsum(n) - n]
        self.count = np.r_[self.count, n]
        self.seen = np.r_[self.seen, np.zeros(len(n), np.int32)]
        self.used += len(new)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, each row's closed with END_ID, and the rows' offsets into them."""
        rows = len(offsets) - 1
        kind = CLASS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = CUT[kind[:-1], kind[1:]]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        word = kind[starts] != _BLANK
        starts, ends = starts[word], ends[word]
        first, inverse = identities(data, starts, ends)
        raw = data.tobytes()
        parts = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known) > CACHE_ENTRIES:
            self.keep_frequent()
        if new := [p for p in parts if p not in self.known]:
            self.learn(new)
        own = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        self.seen[own] += 1
        at = own[inverse]
        n, begin = self.count[at], self.first[at]
        row = row_of(starts, offsets)
        lengths = np.bincount(row, n, rows).astype(np.int64) + 1
        bounds = np.r_[0, np.cumsum(lengths)]
        out = np.full(bounds[-1], END_ID, np.uint32)
        before = np.cumsum(n) - n
        token = np.arange(int(n.sum()))
        out[token + np.repeat(row, n)] = self.ids[token + np.repeat(begin - before, n)]
        return out, bounds


def tokens_of(path: str) -> Tokens:
    return resident(f"tokens {path}", lambda: Tokens(path))


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length and the CRC-32 of its ids.

    A document is its token ids and END_ID; only one longer than length is cut, into pieces of that
    length and a last one that may be shorter. Null text is empty: one piece that holds END_ID.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer)
        for batch in batches:
            tidy(f"tokens {tokenizer}")
            for part in chunks(batch):
                data, offsets = texts_of(part.column(1))
                ids, bounds = tokens.encode(data, offsets)
                whole: dict[int, np.ndarray] = {}  # texts that spell a special token are encoded as they are
                if b"<" in (raw := data.tobytes()):
                    for i in range(len(offsets) - 1):
                        text = raw[offsets[i] : offsets[i + 1]]
                        if b"<" in text and any(s in text.lower() for s in tokens.special):
                            whole[i] = np.array([*tokens.tokenizer.encode(text.decode(), add_special_tokens=False).ids, END_ID], np.uint32)
                found = []
                for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = whole.get(i, ids[s:e])
                    for k, at in enumerate(range(0, len(own), length)):
                        piece = own[at : at + length]
                        found.append((i, k, at, len(piece), zlib.crc32(piece.astype("<u4").tobytes())))
                i, k, at, n, crc = (np.array(x, np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(i)), pa.array(k.astype(np.int32)), pa.array(at), pa.array(n), pa.array(crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


SWEPT = "kind int, ref long, size long, seq long, at long, part int, rank long"
#: What a row of a sweep is: a document with its place, a gap that is left of one, and what found no match.
PLACED, GAP, DOC_LEFT, GAP_LEFT = range(4)
#: Rows that a task sweeps, about.
SWEEP_ROWS = 16_384
#: Sequences are opened when a sweep places at most this share of the documents.
FEW = 0.3
#: Up to so many documents to a sequence, only those that no gap of the opened sequences could hold open one.
SERVED = 10
#: From so many to a sequence on, all that are left open sequences: what these leave is a few hundredths.
SMALL = 24


def open_over(top: int, capacity: int) -> int:
    """Documents over the returned size open sequences, when the longest has size top.

    Where a sequence holds k of the longest, it leaves a gap of less than capacity / (k + 1) or else a gap
    that such a document fits: so documents up to that size wait for these gaps, as they would in
    sequential best fit. With more than SERVED to a sequence gaps are small against it and shorter
    documents fill them: then half of the range of sizes opens at once, and from SMALL on all, for fewer
    rounds.
    """
    per = capacity // max(1, top)
    return 0 if per >= SMALL else min(capacity // (per + 1) if per <= SERVED else top // 2, top - 1)


def sweep(docs: DataFrame, gaps: DataFrame, capacity: int, open_above: int, partitions: int) -> DataFrame:
    """One superstep. Documents (ref, size) and gaps (ref: the sequence, size) are range-sorted together
    by falling size, gaps first among equals. Reading in that order, a document's successor is the last
    gap read that no longer document took: the tightest with room for it. Documents over open_above get
    new sequences instead, as many to one as it holds of their size.

    What finds no match inside its range is ranked: documents by place, gaps from the largest.
    """
    every = docs.select("ref", "size", F.lit(0).alias("gap")).unionByName(gaps.select("ref", "size", F.lit(1).alias("gap")))
    order = [F.desc("size"), F.desc("gap"), F.col("ref")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stack: list[tuple[int, int]] = []
        fresh = used = more = docs_left = 0  # the sequence that was opened last, and how many it still takes
        for batch in batches:
            out = []
            for ref, size, gap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gap:
                    stack.append((ref, size))
                elif size > open_above:
                    if not more:
                        fresh, used, more = ref, 0, max(1, capacity // size)
                    out.append((PLACED, ref, size, fresh, used, None, None))
                    used, more = used + size, more - 1
                    if not more and used < capacity:
                        out.append((GAP, fresh, capacity - used, None, None, None, None))
                elif stack:
                    seq, room = stack.pop()
                    out.append((PLACED, ref, size, seq, capacity - room, None, None))
                    if room > size:
                        out.append((GAP, seq, room - size, None, None, None, None))
                else:
                    out.append((DOC_LEFT, ref, size, None, None, part, docs_left))
                    docs_left += 1
            yield swept_rows(out)
        out = [(GAP_LEFT, seq, room, None, None, part, k) for k, (seq, room) in enumerate(stack)]
        yield swept_rows([*out, (GAP, fresh, capacity - used, None, None, None, None)] if more and used < capacity else out)

    return every.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(run, SWEPT)


def swept_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "ref", "size", "seq", "at", "part", "rank"])


def conflicts(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which documents meet which gaps across ranges, by rank: in order of the ranges, each one's
    documents take the last gaps that earlier ranges left. left: documents and gaps left by range.

    Returns intervals (documents' range, first rank, how many, gaps' range, top rank, first number):
    at most two a range, whatever they hold.
    """
    stack, plan, number = [], [], 0
    for part in sorted(left):
        docs, gaps = left[part]
        rank = 0
        while rank < docs and stack:
            other, room = stack.pop()
            n = min(docs - rank, room)
            plan.append((part, rank, n, other, room - 1, number))
            rank, number = rank + n, number + n
            if room > n:
                stack.append((other, room - n))
        if gaps:
            stack.append((part, gaps))
    return plan


def pack(parts: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to rows with a length, in nearly as few sequences as can be.

    Bulk-synchronous best fit. Rows over half of capacity have a sequence of their own; its gap and the
    other rows go through rounds. In a round a sweep() matches documents with their successors among the
    gaps inside each range, conflicts() settles by rank who gets which gap across ranges, each gap takes
    one document at most, and what is left of it is a gap of the next round. When few documents find a
    gap, the next sweep opens sequences for the longest (open_over). Documents and gaps are tables throughout: the
    driver sees how many each range left, and nothing of them.

    The rows are settled first, so a row keeps its number. Equal and repeated rows have places of their
    own; a row over capacity is alone; null lengths count as none: they take no room, at
    the head of one of the sequences; an empty table gives
    no rows. Columns named sequence_id or offset are replaced.
    """
    kept = [F.col(c) for c in parts.columns if c not in ("sequence_id", "offset")]
    size = F.coalesce(F.col("length").cast("long"), F.lit(0))
    rows = settled(parts.select(F.struct(*kept).alias("row"), F.greatest(size, F.lit(0)).alias("size"))).withColumn("ref", F.monotonically_increasing_id())
    empty, rows = rows.where("size = 0"), rows.where("size > 0")
    own = F.col("size") * 2 > capacity
    alone = rows.where(own)
    docs, gaps = rows.where(~own).select("ref", "size"), alone.where(F.col("size") < capacity).select("ref", (capacity - F.col("size")).alias("size"))
    placed: list[DataFrame] = []
    left, open_above = docs.count(), capacity
    while left:
        partitions = max(2, 2 * left // SWEEP_ROWS)
        swept = settled(sweep(docs, gaps, capacity, open_above, partitions))
        counts = swept.groupBy("kind", "part").agg(F.count("*").alias("n"), F.max("size").alias("top")).collect()
        by_part: dict[int, tuple[int, int]] = {}
        for r in counts:
            if r.kind in (DOC_LEFT, GAP_LEFT):
                d, g = by_part.get(r.part, (0, 0))
                by_part[r.part] = (d + r.n, g) if r.kind == DOC_LEFT else (d, g + r.n)
        plan = conflicts(by_part)
        docs, gaps, more = settle_conflicts(swept, plan, capacity)
        placed.append(swept.where(F.col("kind") == PLACED).select("ref", "seq", "at"))
        if more is not None:
            placed.append(more)
        before, left = left, sum(d for d, _ in by_part.values()) - sum(n for _, _, n, *_ in plan)
        top = max((r.top for r in counts if r.kind == DOC_LEFT), default=0)
        open_above = open_over(top, capacity) if before - left <= FEW * before else capacity
    out = alone.select("row.*", F.col("ref").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed:
        places = placed[0]
        for other in placed[1:]:
            places = places.unionByName(other)
        out = out.unionByName(rows.where(~own).join(places, "ref").select("row.*", F.col("seq").alias("sequence_id"), F.col("at").alias("offset")))
    if empty.isEmpty():
        return out
    some = out.agg(F.coalesce(F.min("sequence_id"), F.lit(0).cast("long")).alias("sequence_id"))
    return out.unionByName(empty.crossJoin(F.broadcast(some)).select("row.*", "sequence_id", F.lit(0).cast("long").alias("offset")))


def settle_conflicts(swept: DataFrame, plan: list[tuple], capacity: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The documents and gaps that a round leaves, and the documents placed across ranges."""
    new_gaps = swept.where(F.col("kind") == GAP).select("ref", "size")
    docs, gaps = (swept.where(F.col("kind") == k).select("ref", "size", "part", "rank") for k in (DOC_LEFT, GAP_LEFT))
    if not plan:
        return docs.select("ref", "size"), new_gaps.unionByName(gaps.select("ref", "size")), None
    known = F.broadcast(swept.sparkSession.createDataFrame(plan, "d_part int, d_first long, n long, g_part int, g_top long, number long"))

    def numbered(left: DataFrame, side: str, met: Column, number: Column) -> tuple[DataFrame, DataFrame]:
        """Of what is left, the rows in ranges of the plan, with their numbers, and all others, which wait as
        they are: few ranges are in it, as gaps go to the longest documents first."""
        inside = F.col("part").isin(sorted({p[0] if side == "d" else p[3] for p in plan}))
        rows = left.where(inside).join(known, (F.col("part") == F.col(f"{side}_part")) & met, "left")
        return rows.select("ref", "size", number.alias("number")), left.where(~inside).select("ref", "size")

    rank, top = F.col("rank"), F.col("g_top")
    docs, waiting = numbered(docs, "d", (rank >= F.col("d_first")) & (rank < F.col("d_first") + F.col("n")), F.col("number") + rank - F.col("d_first"))
    gaps, untouched = numbered(gaps, "g", (rank <= top) & (rank > top - F.col("n")), F.col("number") + top - rank)
    gaps = gaps.select(F.col("ref").alias("seq"), F.col("size").alias("room"), "number")
    met = settled(docs.where("number is not null").join(gaps.where("number is not null"), "number"))
    free = met.where("room > size").select(F.col("seq").alias("ref"), (F.col("room") - F.col("size")).alias("size"))
    unmet = gaps.where("number is null").select(F.col("seq").alias("ref"), F.col("room").alias("size"))
    docs = docs.where("number is null").select("ref", "size").unionByName(waiting)
    return docs, new_gaps.unionByName(untouched).unionByName(unmet).unionByName(free), met.select("ref", "seq", (capacity - F.col("room")).alias("at"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = SEQUENCE) -> DataFrame:
    """pieces() of docs, packed."""
    return pack(pieces(docs, tokenizer, length), length)
