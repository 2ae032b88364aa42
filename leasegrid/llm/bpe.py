"""Byte-level BPE by merge replay over all words of a block of texts.

A task's texts are cut by the pattern, and what is not known yet of their distinct parts ("words") is
encoded at once: the words' bytes lie back to back as a chain of tokens, an inverted index holds for each
rank the positions whose pair of neighbours it joins, and ranks are applied in rising order, all positions
of a rank at once; a merge looks up anew only the two pairs that it touches. Nothing is shuffled: a block
is a corpus of its own, so the work grows with the text alone and a lost task costs its own block.

Rank order and the order of a word by itself (always its least rank, leftmost first) agree as long as no
merge makes a pair of a lower rank than its own. Vocabularies made by merging keep to that nearly always;
a word in which it does happen leaves the replay and is merged by itself, so every result is exact.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, resident, tidy

#: Letters and numbers of later Unicode versions than the one whose classes the tiktoken
#: library splits by. There they are neither.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: A worker forgets the words that it knows when they are more, and encodes them again when they come.
KNOWN_WORDS = 200_000
#: Text that is cut and encoded at a time.
BLOCK_BYTES = 4 << 20
NONE = np.int32(2**31 - 1)


class Splitter:
    """A text's parts by the pattern, with the classes of letters and numbers that tiktoken has."""

    def __init__(self, pattern: str):
        self.newer = regex.compile(f"[{NEWER}]")
        self.plain = regex.compile(pattern)
        # A negated class [^\s\p{L}\p{N}] takes the set inside, a class by itself becomes a set.
        for plain, mark in ((r"\p{L}\p{N}", "\0"), (r"\p{L}", "\1"), (r"\p{N}", "\2")):
            pattern = pattern.replace(plain, mark)
        for plain, mark in ((r"\p{L}\p{N}", "\0"), (r"\p{L}", "\1"), (r"\p{N}", "\2")):
            pattern = pattern.replace(mark, f"[{plain}--[{NEWER}]]")
        self.exact = regex.compile(pattern, regex.V1)

    def __call__(self, text: str) -> list[str]:
        """The slower classes only where a text has a character that they differ in."""
        return (self.plain if text.isascii() or self.newer.search(text) is None else self.exact).findall(text)


class Vocabulary:
    """Tokens by rank, and for every pair of tokens whose bytes together are a token, that token's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        joins = sorted((ranks[a] << 32 | ranks[b], rank) for t, rank in ranks.items() for k in range(1, len(t)) if (a := t[:k]) in ranks and (b := t[k:]) in ranks)
        self.keys = np.array([k for k, _ in joins], np.int64)
        self.joined = np.array([r for _, r in joins], np.int32)
        self.encoders: dict[str, Encoder] = {}

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's token, NONE where it is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.joined[at], NONE)

    def alone(self, word: bytes) -> list[int]:
        """The tokens of one word, its least rank first, leftmost first."""
        n = len(word)
        tok, nxt, prv = self.of_byte[np.frombuffer(word, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda p: self.ranks.get(self.tokens[tok[p]] + self.tokens[tok[nxt[p]]]) if nxt[p] < n else None
        heap = [(r, p, tok[p], tok[p + 1]) for p in range(n - 1) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, p, a, b = heapq.heappop(heap)
            if tok[p] != a or nxt[p] >= n or tok[nxt[p]] != b:
                continue
            gone = nxt[p]
            tok[p], tok[gone], nxt[p] = r, -1, nxt[gone]
            if nxt[p] < n:
                prv[nxt[p]] = p
            for q in (prv[p], p):
                if q >= 0 and (r := rank(q)) is not None:
                    heapq.heappush(heap, (r, q, tok[q], tok[nxt[q]]))
        return [t for t in tok if t >= 0]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all words, back to back, and each word's offset into them."""
    lengths = np.array([len(w) for w in words], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    n = int(offsets[-1])
    tok = np.append(vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
    first = np.zeros(n + 1, bool)  # a word begins here; what comes before is another's
    first[offsets] = True
    nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
    rank = np.full(n + 1, NONE, np.int32)  # of the pair that begins at a position
    inner = np.flatnonzero(~first[1:])
    rank[inner] = vocabulary.joins(tok[inner], tok[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    pending: list[int] = []
    odd: set[int] = set()

    def post(at: np.ndarray) -> None:
        """Enters positions in the index under the rank of their pair."""
        ranks = rank[at]
        if len(at) > 1:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            parts, names = np.split(at, cuts), ranks[np.concatenate([[0], cuts])].tolist()
        else:
            parts, names = [at], ranks.tolist()
        for r, part in zip(names, parts, strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(pending, r)

    if len(start := np.flatnonzero(rank != NONE)):
        post(start)
    while pending:
        r = heapq.heappop(pending)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[rank[at] == r]
        if len(at) > 1:
            # Where one pair's second token is the next pair's first, every other pair of the run merges.
            linked = np.append(False, nxt[at[:-1]] == at[1:])
            if linked.any():
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        # Between one merge and the next beside it, the new token has that pair's first token as its neighbour.
        beside = np.flatnonzero(after[:-1] == at[1:])
        beside = beside[vocabulary.joins(np.full(len(beside), r), tok[at[beside + 1]]) < r] if len(beside) else beside
        tok[at], tok[gone], rank[gone] = r, -1, NONE
        nxt[at] = after
        prv[after] = at
        inside = ~first[after]
        rank[at] = NONE
        rank[at[inside]] = vocabulary.joins(tok[at[inside]], tok[after[inside]])
        left = prv[at[~first[at]]]
        rank[left] = vocabulary.joins(tok[left], tok[nxt[left]])
        touched = np.concatenate([at[inside], left])
        touched = touched[rank[touched] != NONE]
        early = np.concatenate([touched[rank[touched] < r], at[beside]])
        if len(early):
            # These words go another way by themselves: all their pairs leave the replay.
            for w in np.unique(np.searchsorted(offsets, early, "right") - 1).tolist():
                odd.add(w)
                rank[offsets[w] : offsets[w + 1]] = NONE
            touched = touched[rank[touched] != NONE]
        if len(touched):
            post(touched)
    alive = tok[:n] >= 0
    counts = np.concatenate([[0], np.cumsum(alive)])[offsets]
    tokens = tok[:n][alive]
    if odd:
        own = [np.array(vocabulary.alone(words[w]), np.int32) if w in odd else tokens[counts[w] : counts[w + 1]] for w in range(len(words))]
        tokens, counts = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return tokens, counts


class Encoder:
    """Texts to ids; keeps the ids of the words that it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, Splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.tokens, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        if len(self.numbers) > KNOWN_WORDS:
            self.forget()
        split, numbers = self.split, self.numbers
        known = len(numbers)
        rows = [np.array([numbers.setdefault(w, len(numbers)) for w in split(t)], np.int32) for t in texts]
        if len(numbers) > known:
            new = [w.encode() for w in list(numbers)[known:]]
            whole = np.array([self.vocabulary.ranks.get(w, -1) for w in new], np.int64)
            rest = np.flatnonzero(whole < 0)
            merged, at = replay([new[k] for k in rest.tolist()], self.vocabulary)
            sizes = np.ones(len(new), np.int64)
            sizes[rest] = np.diff(at)
            tokens = np.zeros(int(sizes.sum()), np.int32)
            is_rest = np.repeat(whole < 0, sizes)
            tokens[is_rest] = merged
            tokens[~is_rest] = whole[whole >= 0]
            self.tokens = np.concatenate([self.tokens, tokens])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        out = []
        for row in rows:
            start, size = self.offsets[row], self.offsets[row + 1] - self.offsets[row]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.tokens[np.repeat(start - (ends - size), size) + np.arange(total)])
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _vocabulary(path: str) -> Vocabulary:
    return resident(f"bpe:{path}", lambda: Vocabulary(read_ranks(path)))


def _encoder(path: str, pattern: str) -> Encoder:
    vocabulary = _vocabulary(path)
    return vocabulary.encoders.setdefault(pattern, vocabulary.encoders.get(pattern) or Encoder(vocabulary, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each text in place of the text, as little-endian unsigned 32-bit integers
    back to back, the form in which training reads them. No special tokens: their strings are text.

    Null and empty texts have no ids (an empty value). All other columns stay as they are, but one of
    ids_col's name, which is replaced; rows of any number and order are encoded each by itself.
    path names a rank file that every executor has.
    """
    others = [c for c in docs.columns if c not in (text_col, ids_col)]
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others") if others else F.lit(0).alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            tidy(f"bpe:{path}")
            for part in chunks(batch, limit=BLOCK_BYTES):
                ids = [x.astype("<u4").tobytes() for x in encoder.encode(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), part.column(1)], ["ids", "others"])

    out = rows.mapInArrow(run, f"ids binary, others {rows.schema['others'].dataType.simpleString()}")
    return out.select(*([F.col(f"others.`{c}`").alias(c) for c in others]), F.col("ids").alias(ids_col))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for in out_col, which replaces one of that name. Null ids
    count as none; an id that the vocabulary lacks is an error."""
    others = [c for c in encoded.columns if c != out_col]
    rows = encoded.select(F.col(f"`{ids_col}`").alias("ids"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _vocabulary(path).tokens
        for batch in batches:
            tidy(f"bpe:{path}")
            texts = []
            for packed in batch.column(0):
                ids = np.frombuffer(packed.as_py() or b"", "<u4").tolist()
                texts.append(b"".join([tokens[k] for k in ids]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), batch.column(1)], ["decoded", "others"])

    out = rows.mapInArrow(run, f"decoded binary, others {rows.schema['others'].dataType.simpleString()}")
    return out.select(*[F.col(f"others.`{c}`").alias(c) for c in others], F.col("decoded").alias(out_col))
