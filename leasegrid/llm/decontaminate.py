"""Benchmark decontamination: a prefix-filtered join of item windows with document words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, identities, row_of, same_bytes, span_hashes, spans, texts_of, tidy

WINDOW = 10
#: Item words that one block of the benchmark holds; a larger benchmark is joined block by block.
BLOCK_WORDS = 1 << 20
SLICE = 1 << 20

#: Bytes of words once A-Z are lower-cased: digits, letters and all bytes beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


class Words:
    """The words of all rows: their hashes, the rows' offsets into them, and, once asked for, their
    lower-cased bytes one after another, each closed with a zero byte (no word holds one)."""

    def __init__(self, column: pa.Array) -> None:
        self.data, offsets = texts_of(column)
        self.data = LOWER[self.data]
        self.starts, self.ends = spans(WORD[self.data], offsets)
        self.bounds = np.r_[0, np.cumsum(np.bincount(row_of(self.starts, offsets), minlength=len(offsets) - 1))]
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self._line: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def line(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, and where in them each word starts and ends."""
        if self._line is None:
            n = self.ends - self.starts
            own = np.zeros(int(n.sum()) + len(n), np.uint8)
            own[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = self.data[WORD[self.data]]
            end = np.cumsum(n + 1) - 1
            self._line = own, end - n, end
        return self._line


class Windows:
    """The distinct windows of a block of items, indexed by the word of each that is rarest."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        words = Words(pa.array([t for _, t in items], pa.string()))
        own = np.diff(words.bounds)
        many = np.where(own > 0, np.maximum(1, own - window + 1), 0)
        item = np.repeat(np.arange(len(items)), many)
        begin = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(words.bounds[:-1], many)
        length = np.minimum(own[item], window)
        self.line, starts, ends = words.line()
        first, number = identities(self.line, starts[begin], ends[begin + length - 1])
        self.hashes, self.vocabulary = words.hashes, np.unique(words.hashes)
        self.at, self.length = begin[first], length[first]
        self.starts, self.ends = starts[self.at], ends[self.at + self.length - 1]
        pairs = np.unique(number * (len(items) + 1) + item)
        self.names = [i for i, _ in items]
        self.owners, self.owner_starts = pairs % (len(items) + 1), np.searchsorted(pairs // (len(items) + 1), np.arange(len(first) + 1))
        self.window = window

    def owned_by(self, window: int) -> set[str]:
        return {self.names[k] for k in self.owners[self.owner_starts[window] : self.owner_starts[window + 1]].tolist()}

    def order(self, frequency: dict[int, int]) -> None:
        """Orders each window's words by rarity and posts the window under the first of them: for
        containment of the whole window, one prefix word is what is necessary."""
        seen = np.array([frequency.get(h, 0) for h in self.vocabulary.tolist()], np.int64)
        rarity = seen[np.searchsorted(self.vocabulary, self.hashes)] if len(seen) else seen
        place, least = np.zeros(len(self.at), np.int64), np.full(len(self.at), np.iinfo(np.int64).max)
        for k in range(self.window):
            inside = np.flatnonzero(self.length > k)
            rarer = inside[rarity[self.at[inside] + k] < least[inside]]
            place[rarer], least[rarer] = k, rarity[self.at[rarer] + k]
        key = self.hashes[self.at + place]
        self.post = np.argsort(key, kind="stable")
        self.keys, self.first, self.count = np.unique(key[self.post], return_index=True, return_counts=True)
        self.place = place[self.post]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every place in the rows' words where a window occurs."""
        hashes, bounds = words.hashes, words.bounds
        none = (np.zeros(0, np.int64),) * 2
        if not len(self.keys) or not len(hashes):
            return none
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        row = row_of(hit, bounds)
        found = [none]
        pairs = np.cumsum(self.count[at[hit]])
        start = 0
        while start < len(hit):  # a bounded number of candidates at a time
            end = max(start + 1, int(np.searchsorted(pairs, (pairs[start - 1] if start else 0) + SLICE, "right")))
            own, n = hit[start:end], self.count[at[hit[start:end]]]
            post = np.repeat(self.first[at[own]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = self.post[post]
            begin = np.repeat(own, n) - self.place[post]
            low, high = np.repeat(bounds[row[start:end]], n), np.repeat(bounds[row[start:end] + 1], n)
            fits = (begin >= low) & (begin + self.length[window] <= high)  # by position and length
            begin, window = begin[fits], window[fits]
            for k in range(self.window):  # by hash, which leaves little to compare
                inside = np.minimum(k, self.length[window] - 1)
                same = hashes[begin + inside] == self.hashes[self.at[window] + inside]
                begin, window = begin[same], window[same]
            if len(begin):
                line, starts, ends = words.line()
                same = same_bytes(line, starts[begin], ends[begin + self.length[window] - 1], self.line, self.starts[window], self.ends[window])
                found.append((begin[same], window[same]))
            start = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def occurrences(docs: DataFrame, index) -> DataFrame:
    """word and n: how often each of the index's words occurs in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = index.value.vocabulary
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            tidy()
            for part in chunks(batch):
                words = Words(part.column(part.schema.get_field_index("text"))).hashes
                at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                counts += np.bincount(at[vocabulary[at] == words], minlength=len(vocabulary))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[seen].view(np.int64)), pa.array(counts[seen])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mark(docs: DataFrame, index) -> DataFrame:
    """docs with one block's finds added: hits (start, end, start, end, ... of merged hit words) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(part.schema.get_field_index("text")))
                bounds = words.bounds
                begin, window = found.find(words)
                delta = np.zeros(len(words.hashes) + 1, np.int64)
                rows = row_of(begin, bounds)
                old_hits, old_items = part.column(part.schema.get_field_index("hits")), part.column(part.schema.get_field_index("items"))
                items: dict[int, set[str]] = {}
                touched = set(rows.tolist())
                for r, w in set(zip(rows.tolist(), window.tolist(), strict=True)):
                    items.setdefault(r, set()).update(found.owned_by(w))
                for r in touched:
                    if before := old_hits[r].as_py():
                        pairs = np.array(before, np.int64).reshape(-1, 2) + bounds[r]
                        np.add.at(delta, pairs[:, 0], 1)
                        np.add.at(delta, pairs[:, 1], -1)
                np.add.at(delta, begin, 1)
                np.add.at(delta, begin + found.length[window], -1)
                starts, ends = spans(np.cumsum(delta[:-1]) > 0, bounds)
                row = row_of(starts, bounds)
                hits, owned = old_hits.to_pylist(), old_items.to_pylist()
                for r in touched:
                    mine = slice(*np.searchsorted(row, [r, r + 1]))
                    hits[r] = (np.stack([starts[mine], ends[mine]], 1) - bounds[r]).ravel().tolist()
                    owned[r] = sorted(items[r] | set(owned[r]))
                columns = {"n_words": pa.array(np.diff(bounds)), "hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(owned, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([columns.get(n, c) for n, c in zip(part.schema.names, part.columns, strict=True)], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def blocks_of(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items with words, in blocks by a hash of item and text so that a block keeps to about block_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.append_column("n", pa.array(np.diff(Words(part.column(1)).bounds)))

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(run, "item string, text string, n long").where("n > 0")
    blocks = -(-(rows.agg(F.sum("n")).first()[0] or 0) // block_words)
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        if got:
            yield [(r.item, r.text) for r in got]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hits, items: where a document repeats a window of a benchmark item.

    hits lists start and end of each maximal run of hit words; items the item ids, as strings, in
    order. A window is window consecutive words of an item; an item of fewer, but not none, is one.
    Only blocks of bounded size are broadcast: a benchmark of more than block_words words is joined
    in several, one map after another in the same stage, and nothing is shuffled but word counts.
    Hashes of words only say where to look; a window occurs where its bytes are.

    Null texts have no words; null item ids count as an empty id; repeated items and documents count
    each; an empty benchmark hits nothing and an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    marked = rows
    for block in blocks_of(items, block_words) if items is not None else ():
        index = Windows(block, window)
        index.order(frequencies(rows, index))
        marked = mark(marked, spark.sparkContext.broadcast(index))
    if marked is rows:
        marked = mark(rows, spark.sparkContext.broadcast(empty_index(window)))
    return marked.select("doc_id", "n_words", "hits", "items")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, that repeat no window of a benchmark item, as decontaminate() finds them.

    Null and empty texts repeat none and stay; repeated rows go or stay alike; an empty benchmark takes
    nothing away and an empty table gives no rows. All columns are returned as they are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def without(docs: DataFrame, index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tidy()
                for part in chunks(batch, text_col):
                    words = Words(part.column(part.schema.get_field_index(text_col)))
                    free = np.ones(part.num_rows, bool)
                    free[row_of(index.value.find(words)[0], words.bounds)] = False
                    yield part.filter(pa.array(free))

        return docs.mapInArrow(run, docs.schema)

    for block in blocks_of(items, block_words):
        index = Windows(block, window)
        index.order(frequencies(rows, index))
        docs = without(docs, spark.sparkContext.broadcast(index))
    return docs


def frequencies(rows: DataFrame, index: Windows) -> dict[int, int]:
    seen = occurrences(rows, rows.sparkSession.sparkContext.broadcast(index)).collect()
    return {r.word % (1 << 64): r.n for r in seen}


def empty_index(window: int) -> Windows:
    index = Windows([], window)
    index.order({})
    return index


def report(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items in place of the lists."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: x - n)  # ends less starts: the sign turns with each bound
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
