"""Quality classifier: random-indexing word vectors pooled per document, and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER, chunks, mix, row_of, span_hashes, spans, texts_of

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 64, 4, 2
#: Labelled rows that the classifier is fitted on at most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
SLICE = 1 << 17
#: Ranges of buckets that the tasks' partial sums are added up by.
RANGES = 64
UPPER, AGAIN = 0, 1  # tokens that stand for a word in capitals and for a word said twice running

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows' tokens in order, and the rows' offsets into them: lower-cased words,
    runs of other characters, and marks of capitals and repeats after their word."""
    data, offsets = texts_of(column)
    kind = np.where(_WORD[data], 1, np.where(BLANK[data], 0, 2)).astype(np.int8)
    word_starts, word_ends = spans(kind == 1, offsets)
    sign_starts, sign_ends = spans(kind == 2, offsets)
    capital = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    upper = (capital[word_ends] - capital[word_starts] >= 2) & (capital[word_ends] - capital[word_starts] == word_ends - word_starts)
    low = LOWER[data]
    word = span_hashes(low, word_starts, word_ends)
    row = row_of(word_starts, offsets)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    bucket = lambda h: (h % np.uint64(BUCKETS - 2)).astype(np.int64) + 2
    at = np.concatenate([word_starts, sign_starts, word_starts[upper], word_starts[again]])
    what = np.concatenate([bucket(word), bucket(span_hashes(data, sign_starts, sign_ends)), np.full(upper.sum(), UPPER), np.full(again.sum(), AGAIN)])
    order = np.argsort(at, kind="stable")
    return what[order], np.searchsorted(at[order], offsets)


def entries() -> tuple[np.ndarray, np.ndarray]:
    """The sparse index vector of each bucket: NONZERO places of +1 or -1, a fixed function of its number."""
    h = mix(np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(1, NONZERO + 1, dtype=np.uint64))
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def index_vectors() -> np.ndarray:
    """The index vectors with all their dimensions."""
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    places, signs = entries()
    np.add.at(out, (np.arange(BUCKETS)[:, None], places), signs)
    return out


def contexts(column: pa.Array, places: np.ndarray, signs: np.ndarray, sums: np.ndarray) -> None:
    """Adds to each token's sum the index vectors of the tokens within REACH of it in its row."""
    what, bounds = tokens(column)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for gap in range(1, REACH + 1):
        for at in range(0, max(0, len(what) - gap), SLICE):
            left, right = what[at : at + SLICE], what[at + gap : at + gap + SLICE]
            left = left[: len(right)]
            same = row[at : at + len(left)] == row[at + gap : at + gap + len(right)]
            left, right = left[same], right[same]
            for to, other in ((left, right), (right, left)):
                key = to[:, None] * DIMENSIONS + places[other]
                sums += np.bincount(key.ravel(), signs[other].ravel(), BUCKETS * DIMENSIONS)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean of the rows' token vectors; zero for a row without tokens."""
    what, bounds = tokens(column)
    out = np.zeros((len(bounds) - 1, vectors.shape[1]), np.float64)
    for at in range(0, len(what), SLICE):
        own = vectors[what[at : at + SLICE]]
        first = np.searchsorted(bounds, at, "right") - 1
        last = np.searchsorted(bounds, min(at + SLICE, len(what)), "left")
        cuts = np.maximum(bounds[first:last] - at, 0)
        filled = np.flatnonzero(np.diff(np.r_[cuts, len(own)]) > 0)
        out[first + filled] += np.add.reduceat(own, cuts[filled], axis=0)
    return out / np.maximum(1, np.diff(bounds))[:, None]


@dataclass
class Model:
    """Vectors by bucket, the network's layers, and the temperature of its output."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Model:
    """Fits the network by Adam on four fifths of the rows and its temperature on the others."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    width = x.shape[1]
    mean = x[own].mean(axis=0) if len(own) else np.zeros(width)
    scale = np.full(width, x[own].std() + 1e-3) if len(own) else np.ones(width)  # one for all: what varies most counts most
    layers = [random.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
    model = Model(vectors, mean, scale, layers)
    layers[2] += random.normal(0, hidden**-0.5, hidden)
    if not len(own):
        layers[2][:] = 0
        return model
    z = (x - mean) / scale
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(own), -(-len(own) // 128)):
            h = np.tanh(z[batch] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3][0], -40, 40)))
            d = (p - y[batch]) / len(batch)
            back = np.outer(d, layers[2]) * (1 - h * h)
            slopes = [z[batch].T @ back + 1e-4 * layers[0], back.sum(axis=0), h.T @ d + 1e-4 * layers[2], np.array([d.sum()])]
            step += 1
            for w, g, m, v in zip(layers, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(held):
        logits = model.logits(x[held])
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t)
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def context_sums(docs: DataFrame) -> np.ndarray:
    """Each bucket's context vector, summed over the texts of all rows.

    A task sends one row for each range of buckets, and a Spark aggregation adds them up, so the
    driver gets BUCKETS sums at any size. Sums are whole numbers, so their order does not matter.
    """
    width = BUCKETS // RANGES
    places, signs = entries()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for part in chunks(batch):
                contexts(part.column(0), places, signs, sums)
        for k in range(RANGES):
            own = sums[k * width * DIMENSIONS : (k + 1) * width * DIMENSIONS]
            if own.any():
                packed = pa.compress(own.astype(np.int64).tobytes(), "zstd").to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["range", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width * DIMENSIONS, np.int64)
        for packed in table["sums"]:
            total += np.frombuffer(pa.decompress(packed.as_py(), total.nbytes, "zstd"), np.int64)
        return pa.table({"range": table["range"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    sent = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(add, "range int, sums binary")
    sums = np.zeros((RANGES, width * DIMENSIONS))
    for row in sent.groupBy("range").applyInArrow(merge, "range int, sums binary").collect():
        sums[row["range"]] = np.frombuffer(row.sums, np.int64)
    return sums.reshape(BUCKETS, DIMENSIONS)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The word vectors from the texts of all of docs, and a network fitted on at most sample_rows rows
    of labelled documents (doc_id, quality of labels; doc_id, text of docs), repeated ids included.

    Texts stay on the executors; the summed vectors and one pooled vector a row of the sample reach
    the driver. Rows with a null label or id are not used to fit the network, an id with two labels
    has the higher one.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").repartition(8, "doc_id")
    index = index_vectors()
    sums = context_sums(docs)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = (np.where(size > 0, sums / np.maximum(size, 1e-9), 0) + 0.5 * index / NONZERO**0.5).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                own = pooled(part.column(1), shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in own], pa.binary()), part.column(2).cast(pa.int32())], ["doc_id", "x", "y"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    vectors_of = sample.mapInArrow(pool, f"doc_id {kind}, x binary, y int")
    # An id may have many rows: the bound is on rows.
    got = sorted(vectors_of.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample_rows).collect(), key=lambda r: (r.doc_id, r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float64).reshape(-1, DIMENSIONS)
    return train(vectors, x, np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher for quality 1) of every row, by its whole text alone.

    Null and empty texts score as the zero vector; with no labels to learn from every score is 0.5.
    Repeated and null ids are rows of their own.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(pooled(part.column(1), shared.value.vectors)))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
