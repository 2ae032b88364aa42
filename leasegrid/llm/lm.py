"""Language-model scoring with an n-gram trie in Elias-Fano form.

The model is an n-gram model over words, of order 2 unless told otherwise. Its unigrams are the add-one
estimate p1 from exact counts of all training tokens. An n-gram of context h and word w has

    p(w | h) = (n(h, w) + PRIOR p(w | h')) / (n(h) + PRIOR),

where h' is h without its first word: a Dirichlet prior centred on the shorter context. The probabilities
of all words and of one unknown word add up to 1 after any context, also after one never seen.

Every n-gram of the training rows counts, whatever the size of the corpus. Documents lie in blocks. Order
by order, a block asks slices of all n-grams for the counts of its own ones, each distinct one once, and
is scored with the part of the trie that it needs. Slices number words and n-grams, so words are compared
byte for byte in one place, and by their numbers from there on.
"""

from __future__ import annotations

import mmap
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, CHUNK_BYTES, LOWER, chunks, identities, mix, row_of, settled, span_hashes, spans, tasks, texts_of, tidy

ORDER = 2
PRIOR = 4.0
#: Tokens after which a block of documents ends, and tokens of the table for each slice of n-grams.
BLOCK_TOKENS, SLICE_TOKENS = 1 << 21, 1 << 22
#: Slices of a small table, at most the shuffle's partitions.
LEAST_SLICES = 64
#: The end of a text, and the context of its first word: no words, as words hold no blanks.
END, START = b"\n", b" "
#: Probabilities are kept in steps of 1 / 4096 of a power of ten.
STEP = 4096.0


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, like places together, compressed."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pickle.dumps((len(numbers), pa.compress(planes.tobytes(), "zstd").to_pybytes()))


def unsqueeze(blob: bytes) -> np.ndarray:
    n, packed = pickle.loads(blob)
    planes = np.frombuffer(pa.decompress(packed, n * 8, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


class EliasFano:
    """A monotone sequence: low bits packed side by side, high bits in unary."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, int(np.log2(max(1, top) / max(1, self.n)))) if self.n else 0
        packed = bytearray()
        places = np.arange(self.low_bits, dtype=np.uint64)
        for at in range(0, self.n if self.low_bits else 0, 1 << 16):  # a multiple of 8 values fills whole bytes
            packed += np.packbits(((values[at : at + (1 << 16), None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        self.low = np.frombuffer(bytes(packed) + bytes(16 + -len(packed) % 8), np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        unary = np.zeros(self.n + (top >> self.low_bits) + 2, np.uint8)
        unary[high + np.arange(self.n)] = 1
        self.high = np.packbits(unary, bitorder="little")
        self.length = len(unary)

    def open(self) -> None:
        """Makes the directory of where each high part starts, for searches."""
        zero = np.unpackbits(np.asarray(self.high), bitorder="little")[: self.length] == 0
        zeros = np.flatnonzero(zero).astype(np.int32 if self.length < 1 << 31 else np.int64)
        self.starts = np.zeros(len(zeros) + 1, zeros.dtype)
        np.subtract(zeros, np.arange(len(zeros), dtype=zeros.dtype), out=self.starts[1:])

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.low_bits) - 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at these places."""
        high = np.searchsorted(self.starts, places, "right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(places)

    def find(self, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each value among those from left to right, -1 for one that is not there: the
        first that is no less, sought where both the range and the value's high part allow it."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high = np.minimum((values >> np.uint64(self.low_bits)).astype(np.int64), len(self.starts) - 2)
        inside = (values >> np.uint64(self.low_bits)).astype(np.int64) == high
        left, right = np.maximum(left, self.starts[high]), np.minimum(right, self.starts[high + 1])
        end, want = right.copy(), values & np.uint64((1 << self.low_bits) - 1)
        at = np.flatnonzero(left < right)
        while len(at):
            middle = (left[at] + right[at]) >> 1
            less = self.lows(middle) < want[at]
            left[at] = np.where(less, middle + 1, left[at])
            right[at] = np.where(less, right[at], middle)
            at = at[left[at] < right[at]]
        found = inside & (left < end)
        at = np.flatnonzero(found)
        found[at] = self.lows(left[at]) == want[at]
        return np.where(found, left, -1)


def steps(p: np.ndarray) -> np.ndarray:
    """Probabilities as steps of their logarithms."""
    return np.minimum(np.round(-np.log10(p) * STEP), 65535).astype(np.uint16)


class Level:
    """The n-grams of one order, in order of context and word: for each context where its successors
    start (monotone pointers), the successors' words (one monotone sequence, each context's words raised
    by a base of its own), their probabilities, and what a context leaves to the shorter one."""

    def __init__(self, context: np.ndarray, word: np.ndarray, p: np.ndarray, seen: np.ndarray, words: int) -> None:
        self.words = words
        self.pointers = EliasFano(np.r_[0, np.cumsum(np.bincount(context, minlength=len(seen)))].astype(np.uint64))
        self.successors = EliasFano(context.astype(np.uint64) * np.uint64(words) + word.astype(np.uint64))
        self.p, self.rest = steps(p), steps(PRIOR / (seen + PRIOR))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each context's successor, -1 where it has no such one."""
        left, right = (self.pointers.at(context + k).astype(np.int64) for k in (0, 1))
        return self.successors.find(context.astype(np.uint64) * np.uint64(self.words) + word.astype(np.uint64), left, right)


class Trie:
    """The counts of the words, and a level for each order from 2 on. An n-gram's number at its level is
    what it is called as a context one level up; words are contexts by their own numbers."""

    def __init__(self, counts: np.ndarray, total: int, distinct: int) -> None:
        self.total, self.distinct = total, distinct
        self.counts = EliasFano(np.r_[np.uint64(0), np.cumsum(counts).astype(np.uint64)])
        self.levels: list[Level] = []

    def arrays(self) -> list[tuple[object, str]]:
        return [(x, a) for x in (self.counts, *(y for v in self.levels for y in (v.pointers, v.successors))) for a in ("low", "high")] + [(v, a) for v in self.levels for a in ("p", "rest")]

    def mapped(self) -> Trie:
        """The trie with its arrays in one mapped file, which has no name and goes with the process."""
        with tempfile.TemporaryFile() as file:
            places = []
            for owner, name in self.arrays():
                own = getattr(owner, name)
                places.append((owner, name, file.tell(), own.dtype, len(own)))
                file.write(own.tobytes() + bytes(-own.nbytes % 8))
            file.write(bytes(8))
            file.flush()
            file_map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        for owner, name, at, kind, n in places:
            setattr(owner, name, np.frombuffer(file_map, kind, n, at))
        for x in (self.counts, *(y for v in self.levels for y in (v.pointers, v.successors))):
            x.open()
        return self

    def unigrams(self) -> np.ndarray:
        """log10 of p1 of each word."""
        counts = np.diff(self.counts.at(np.arange(self.counts.n)).astype(np.int64))
        return np.log10((counts + 1.0) / (self.total + self.distinct + 1))


class Grams:
    """The distinct pairs of a context and a word, in order: counts in the block's training rows, where
    each is first, the tokens that end one, and the number of every such token's pair."""

    def __init__(self, context: np.ndarray, word: np.ndarray, train: np.ndarray, tokens: np.ndarray) -> None:
        self.tokens = tokens
        code, self.first, self.number = np.unique((context << 32) | word, return_index=True, return_inverse=True)
        self.context, self.word = code >> 32, code & ((1 << 32) - 1)
        self.counts = np.bincount(self.number, train, len(code)).astype(np.int64)


SENT = "slice int, block long, level int, a binary, b binary, c binary"


def sent(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SENT; arrays are squeezed."""
    packed = [(s, b, k, *[x if x is None or isinstance(x, bytes) else squeeze(x) for x in (*arrays, None, None)[:3]]) for s, b, k, *arrays in rows]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*packed, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "block", "level", "a", "b", "c"])


def joined(table: pa.Table, name: str, steps_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of arrays, of which the steps may be what is kept, and where each row's start."""
    parts = [unsqueeze(x.as_py()) for x in table[name]]
    parts = [np.cumsum(x, dtype=np.uint64) for x in parts] if steps_only else parts
    return np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.int64), np.cumsum([0, *map(len, parts)])


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash: ranges of equal width."""
    return ((hashes >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def cuts_of(slices: np.ndarray) -> list[tuple[int, slice]]:
    """The slices that are there, which lie in order, with the part of each."""
    first = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(slices) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(slices)]
    return [(int(slices[i]), slice(i, j)) for i, j in zip(first.tolist(), ends.tolist(), strict=False)]


def blocks(rows: DataFrame, block_tokens: int) -> DataFrame:
    """Rows in blocks: their ids and train marks (as Arrow), the distinct words (lengths and bytes), each
    token's place among them, and the tokens of each row. END is at place 0, START at 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        block = TaskContext.get().partitionId() << 32

        def made() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks()
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, own.schema) as stream_out:
                    stream_out.write_table(own)
                ids = out.getvalue().to_pybytes()
            line, names = np.concatenate(lines), list(places)
            # Frequent words have small places, which take fewer bytes; END and START keep theirs.
            order = np.r_[0, 1, 2 + np.argsort(-np.bincount(line, minlength=len(names))[2:], kind="stable")]
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            words = [names[i] for i in order.tolist()]
            packed = pickle.dumps((squeeze(np.fromiter(map(len, words), np.int64)), pa.compress(b"".join(words), "zstd").to_pybytes()))
            values = [block, size, ids, packed, squeeze(place[line]), squeeze(np.concatenate(lengths))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)], ["block", "tokens", "ids", "words", "line", "lengths"])

        held, lines, lengths, size, places = [], [], [], 0, {END: 0, START: 1}
        for batch in batches:
            for part in chunks(batch, limit=min(CHUNK_BYTES, 4 * block_tokens)):
                data, offsets = texts_of(part.column(1))
                data = LOWER[data]
                starts, ends = spans(~BLANK[data], offsets)
                first, number = identities(data, starts, ends)
                raw = data.tobytes()
                own = np.array([places.setdefault(raw[s:e], len(places)) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
                row = row_of(starts, offsets)
                n = np.bincount(row, minlength=part.num_rows) + 1
                line = np.zeros(n.sum(), np.int64)
                line[np.arange(len(starts)) + row] = own[number] if len(own) else 0
                held.append(part.select(["doc_id", "train"]))
                lines.append(line)
                lengths.append(n)
                size += len(line)
                if size >= block_tokens:
                    yield made()
                    block += 1
                    held, lines, lengths, size, places = [], [], [], 0, {END: 0, START: 1}
        if held:
            yield made()

    return rows.select("doc_id", "text", "train").mapInArrow(run, "block long, tokens long, ids binary, words binary, line binary, lengths binary")


class Block:
    """A row of blocks(), opened, and what the slices have answered so far."""

    def __init__(self, row: dict, answers: pa.Table | None, slices: int) -> None:
        self.slices = slices
        self.ids = pa.ipc.open_stream(row["ids"]).read_all()
        lengths, packed = pickle.loads(row["words"])
        self.ends = np.cumsum(unsqueeze(lengths)).astype(np.int64)
        self.starts = np.r_[0, self.ends[:-1]]
        self.data = np.frombuffer(pa.decompress(packed, int(self.ends[-1]), "zstd"), np.uint8)
        self.line = unsqueeze(row["line"]).astype(np.int64)
        self.lengths = unsqueeze(row["lengths"]).astype(np.int64)
        self.bounds = np.r_[0, np.cumsum(self.lengths)]
        self.rows_train = self.ids["train"].to_numpy().astype(bool)
        self.train = np.repeat(self.rows_train, self.lengths)
        #: How often this block's training rows have each word; for START, how many they are.
        self.local = np.bincount(self.line[self.train], minlength=len(self.ends))
        self.local[1] = self.rows_train.sum()
        if answers is not None:
            self.answers = answers.sort_by([("level", "ascending"), ("slice", "ascending")])
            self.n, self.word_ids = self.answered(1, self.words_by_slice()[0])

    def answered(self, level: int, order: np.ndarray, numbered: bool = True) -> list[np.ndarray]:
        """Counts over all training rows, and numbers, of what was asked in this order."""
        own, out = self.answers.filter(pc.equal(self.answers["level"], level)), []
        for name in ("a", "b")[: 1 + numbered]:
            values = np.empty(len(order), np.int64)
            values[order] = joined(own, name, name == "b")[0]
            out.append(values)
        return out

    def words_by_slice(self) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        own = slice_of(span_hashes(self.data, self.starts, self.ends), self.slices)
        order = np.argsort(own, kind="stable")
        return order, cuts_of(own[order])

    def ask_words(self) -> list[tuple]:
        order, parts = self.words_by_slice()
        lengths = self.ends - self.starts
        return [(k, 1, lengths[order[p]], b"".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in order[p].tolist()), self.local[order[p]]) for k, p in parts]

    def levels(self, upto: int) -> Iterator[Grams]:
        """The n-grams of each order from 2 on whose context was seen in training. Counts over all
        training rows have to be known up to the order before the last."""
        first = np.zeros(len(self.line), bool)
        first[self.bounds[:-1]] = True
        context, tokens, ids = np.r_[0, self.line[:-1]], np.arange(len(self.line)), self.word_ids
        context[first] = 1
        for level in range(2, upto + 1):
            grams = Grams(context, self.line[tokens], self.train[tokens], tokens)
            u, w = ids[grams.context], self.word_ids[grams.word]
            own = slice_of(mix(mix(u.astype(np.uint64)) + w.astype(np.uint64)), self.slices)
            grams.order = np.lexsort((w, u, own))
            grams.u, grams.w, grams.parts = u[grams.order], w[grams.order], cuts_of(own[grams.order])
            yield grams
            if level == upto:
                return
            counts, ids = self.answered(level, grams.order)
            index = np.full(len(self.line), -1, np.int64)
            index[tokens] = np.where(counts[grams.number] > 0, grams.number, -1)
            tokens = np.flatnonzero(~first & (np.r_[-1, index[:-1]] >= 0))
            context = index[tokens - 1]

    def ask(self, level: int) -> list[tuple]:
        for grams in self.levels(level):
            pass
        counts = grams.counts[grams.order]
        return [(k, level, np.diff(grams.u[p], prepend=0), grams.w[p], counts[p]) for k, p in grams.parts]


def counted_words(table: pa.Table, slices: int) -> list[tuple]:
    """A slice's words: to each block, their counts over all training rows and their numbers; and (block
    -1) the number of training tokens and of distinct ones."""
    lengths, cuts = joined(table, "a")
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(x.as_py() for x in table["b"]), np.uint8)
    first, number = identities(data, ends - lengths, ends)
    own = table["slice"][0].as_py()
    n = np.bincount(number, joined(table, "c")[0], len(first)).astype(np.int64)
    true = n[[bytes(data[ends[i] - lengths[i] : ends[i]]) != START for i in first.tolist()]]
    out = [(own, block.as_py(), 1, n[number[i:j]], np.diff(number[i:j] * slices + own, prepend=0)) for block, i, j in zip(table["block"], cuts[:-1], cuts[1:], strict=True)]
    return [*out, (own, -1, 1, np.array([true.sum(), (true > 0).sum()]))]


def counted(table: pa.Table, slices: int, numbered: bool) -> list[tuple]:
    """A slice's n-grams of one order: to each block their counts over all training rows, and numbers."""
    (u, cuts), w, n = joined(table, "a", True), joined(table, "b")[0], joined(table, "c")[0]
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])]
    number = np.empty(len(u), np.int64)
    number[order] = np.cumsum(new) - 1
    sums = np.add.reduceat(n[order], np.flatnonzero(new))
    own, level = table["slice"][0].as_py(), table["level"][0].as_py()
    return [(own, block.as_py(), level, sums[number[i:j]], *([np.diff(number[i:j] * slices + own, prepend=0)] if numbered else [])) for block, i, j in zip(table["block"], cuts[:-1], cuts[1:], strict=True)]


def trie_of(b: Block, order: int, total: int, distinct: int) -> tuple[Trie, list[tuple[np.ndarray, ...]]]:
    """The trie of a block's n-grams; and for each order from 2, the tokens to score, the number of
    each one's n-gram, and the n-grams' contexts (as their level numbers them) and words."""
    trie, looked_up = Trie(b.n, total, distinct), []
    shorter, seen, place = (b.n + 1.0) / (total + distinct + 1), b.n, None
    for level, grams in enumerate(b.levels(order) if order > 1 else (), 2):
        counts = b.answered(level, grams.order, False)[0]
        stored = counts > 0
        context = grams.context if place is None else place[grams.context]
        suffix = grams.word if place is None else place[number[grams.tokens[grams.first]]]
        p = (counts + PRIOR * shorter[suffix]) / (seen[context] + PRIOR)
        trie.levels.append(Level(context[stored], grams.word[stored], p[stored], seen, len(b.ends)))
        looked_up.append((grams.tokens, grams.number, context, grams.word))
        shorter, seen, place = p[stored], counts[stored], np.cumsum(stored) - 1
        number = np.zeros(len(b.line), np.int64)
        number[grams.tokens] = grams.number
    return trie, looked_up


def score(docs: DataFrame, train: Column, block_tokens: int = BLOCK_TOKENS, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    train says which rows the model learns from; all their n-grams count. block_tokens is the number of
    tokens after which a block ends and changes no score. Null texts are empty: the end alone. A null
    in train is false. Repeated rows count each; a text longer than a block is one; with nothing to learn
    from all probabilities are 1; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    found = settled(blocks(rows, block_tokens))
    tokens = found.agg(F.sum("tokens")).first()[0] or 0
    slices = max(min(tasks(spark), LEAST_SLICES), -(-tokens // SLICE_TOKENS))

    def asked(level: int, so_far: DataFrame | None) -> DataFrame:
        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield sent([(k, row["block"], *x) for k, *x in Block(row, None, slices).ask_words()])
            tidy()

        def grams(block: pa.Table, answers: pa.Table) -> pa.Table:
            row = block.to_pylist()[0]
            out = sent([(k, row["block"], *x) for k, *x in Block(row, answers, slices).ask(level)])
            tidy()
            return pa.Table.from_batches([out])

        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by("block")  # so that numbers are the same whenever they are dealt
            out = sent(counted_words(table, slices) if level == 1 else counted(table, slices, level < order))
            tidy()
            return pa.Table.from_batches([out])

        asks = found.mapInArrow(words, SENT) if so_far is None else found.groupBy("block").cogroup(so_far.groupBy("block")).applyInArrow(grams, SENT)
        return asks.groupBy("slice").applyInArrow(merge, SENT)

    first = settled(asked(1, None))
    totals = [unsqueeze(r.a) for r in first.where("block < 0").select("a").toLocalIterator()]
    total, distinct = (int(sum(x[k] for x in totals)) for k in (0, 1))
    # From here on one plan, in which the blocks are dealt once and read for every order.
    answers = first.where("block >= 0")
    for level in range(2, order + 1):
        answers = answers.unionByName(asked(level, answers))

    def run(block: pa.Table, table: pa.Table) -> pa.Table:
        b = Block(block.to_pylist()[0], table, slices)
        trie, asked_of = trie_of(b, order, total, distinct)
        trie.mapped()
        base = trie.unigrams()[b.line]
        model = base.copy()
        for level, (own, number, context, word) in zip(trie.levels, asked_of, strict=True):
            at = level.find(context, word)
            known, step = at >= 0, level.rest[context] / STEP
            step[known] = level.p[at[known]] / STEP
            model[own] = np.where(known[number], 0.0, model[own]) - step[number]
        row = np.repeat(np.arange(len(b.lengths)), b.lengths)
        sums = [np.bincount(row, x, len(b.lengths)) for x in (b.n[b.line] > 0, base, model)]
        ids, n_tokens = b.ids["doc_id"], b.lengths
        del trie, b, asked_of, base, model, row
        tidy()
        return pa.table({"doc_id": ids, "n_tokens": n_tokens, "n_known": sums[0].astype(np.int64), "train_tokens": np.full(len(n_tokens), total), "base_score": sums[1], "score": sums[2]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
