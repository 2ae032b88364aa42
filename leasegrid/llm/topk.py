"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks

CANDIDATES_A_CELL = 16_384
QUERIES_A_CELL = 1_024


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term (column): which rows have a weight for it, and the weights."""
    out = []
    for column in rows.T:
        at = np.flatnonzero(column)
        out.append((slice(None), column.copy()) if len(at) == len(column) else (at, column[at]))
    return out


LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id long, query_key string, vec_id long, score long, beyond int, digits string"


def best_of(q_id: int, c_ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which candidates are the k best, in order, ties to the smaller id, the query's own id left out."""
    allowed = np.flatnonzero(c_ids != q_id)
    own = scores[allowed]
    if own.dtype == object:
        return allowed[sorted(range(len(own)), key=lambda i: (-own[i], c_ids[allowed[i]]))[:k]]
    if len(own) > k:
        kept = own >= np.partition(own, len(own) - k)[len(own) - k]
        allowed, own = allowed[kept], own[kept]
    return allowed[np.lexsort((c_ids[allowed], -own))[:k]]


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, np.ndarray, list[int]]]:
    """For each query its number, which candidates are its k best, and their scores.

    Scores that could pass 64 bits are added up as numbers without bounds.
    """
    largest = lambda x: int(np.abs(x).max()) if x.size else 0
    exact = q.shape[1] * largest(q) * largest(c) < 1 << 62
    kind = (lambda x: x.astype(np.int64)) if exact else np.vectorize(int, otypes=[object])
    q, c = (kind(x) if x.size else x for x in (q, c))
    lists, found = postings(c), []
    scores = np.zeros(len(c_ids), np.int64 if exact else object)  # one dense array, used again for every query
    for number, (q_id, row) in enumerate(zip(q_ids, q, strict=True)):
        scores[:] = 0
        for term in np.flatnonzero(row):
            at, weights = lists[term]
            scores[at] += row[term] * weights
        best = best_of(q_id, c_ids, scores, k)
        found.append((number, best, [int(x) for x in scores[best]]))
    return found


def beyond(score: int) -> tuple[int, int, str | None]:
    """The score within 64 bits, on which side it passes them, and then its digits, greater ones last."""
    if LEAST <= score <= MOST:
        return score, 0, None
    digits = f"{len(str(abs(score))):05d}{abs(score)}"
    return (MOST, 1, digits) if score > 0 else (LEAST, -1, digits.translate(str.maketrans("0123456789", "9876543210")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    whole = all(x.dtype.kind == "i" for x in vectors)
    out = np.zeros((len(vectors), width), np.int64 if whole else np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest integer inner products.

    Both tables have vec_id and weights (an array of bigint, or of doubles that are whole numbers;
    position = term). Every query meets every candidate: both are dealt into blocks of bounded size, a
    cell is a block of queries with a block of candidates, and a cell sends on at most k rows a query.

    Candidates with the query's own id are left out; terms beyond a shorter vector count as zero. Null
    ids, weights or components take no part. A candidate repeated row for row counts each time, which can
    matter k times; a query repeated row for row is one, and one of another vector is a query of its own.
    Ranks are exact however large the scores; a score beyond 64 bits is returned as the last number
    on its side. Other columns are ignored. An empty table on either side gives no rows.
    """
    whole = lambda df: df.where(F.col("vec_id").isNotNull() & F.col("weights").isNotNull() & ~F.exists("weights", lambda x: x.isNull()))
    tally = lambda df: whole(df.select(F.col("vec_id").cast("long").alias("vec_id"), "weights")).groupBy("vec_id", "weights").agg(F.count("*").alias("n"))
    queries = tally(queries).select("vec_id", "weights")
    candidates = tally(candidates).select("vec_id", "weights", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    nq, nc = queries.count(), candidates.count()
    rows, columns = -(-nq // QUERIES_A_CELL), -(-nc // CANDIDATES_A_CELL)
    columns = max(columns, min(nc // 1024 + 1, tasks(queries.sparkSession)) // max(1, rows))
    deal = lambda n, *more: F.pmod(F.xxhash64("vec_id", "weights", *more), F.lit(max(1, n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    q = queries.withColumn("key", F.sha2(F.col("weights").cast("string").cast("binary"), 256)).withColumn("r", deal(rows)).withColumn("c", every(columns))
    d = candidates.withColumn("c", deal(columns, "copy")).withColumn("r", every(rows))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(left["weights"].map(len).max(), right["weights"].map(len).max())
            q_ids, keys, c_ids = left["vec_id"].to_numpy(), left["key"].to_numpy(), right["vec_id"].to_numpy()
            for i, best, scores in search_block(q_ids, matrix(left["weights"], width), c_ids, matrix(right["weights"], width), k):
                out += [(q_ids[i], keys[i], c_ids[j], *beyond(x)) for j, x in zip(best, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "query_key", "vec_id", "score", "beyond", "digits"])

    best = q.groupBy("r", "c").cogroup(d.groupBy("r", "c")).applyInPandas(cell, FOUND)
    by_score = Window.partitionBy("query_id", "query_key").orderBy(F.desc("beyond"), F.desc("score"), F.desc("digits"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and weights, floor(scale * x) of every component x as a double (whole numbers, exact at any
    size); without vectors that are null or hold a null or a component that is not finite, or not
    once it is scaled."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    whole = lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)
    return vectors.where(F.col("embedding").isNotNull() & ~F.exists(x, bad)).select("vec_id", F.transform(x, whole).alias("weights"))
