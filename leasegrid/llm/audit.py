"""Which documents five quality filters take from each other, in every order in which they may run.

Each row gets a set of failed conditions as bits, A lowest. A to D come from its own text in the scan. E,
"a smaller doc_id has this text", is a left-semi join of the rows with the first id of every text, on the
hash, the exact text and the smaller id; rows that share a text are reduced to that first id in the task
that reads them, so a text with any number of copies is one row on that side, and copies on the other side
have nothing to meet but this row. The ids that the join keeps are united with the ids of the other
failures. Orders are worked out from the counts of bit combinations alone, at most 32 a part and label.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
WORD_BREAK = r"[\x20\x09-\x0D]+"


def _bit(name: str, fails: Column) -> Column:
    return F.when(fails, BIT[name]).otherwise(0)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, digest and fails (the bits that a row fails) of every row.

    Null text is the empty text, a null part the empty string. A null doc_id is smaller than none and
    has none smaller. Rows alike in id, part and text fail alike and stay as many; rows of one id do
    not repeat each other. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    key = ["doc_id", "part", "digest"]
    counted = rows.select(*key, "text", F.array_remove(F.split("text", WORD_BREAK), "").alias("words")).select(
        *key, "text", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct")
    )
    by_text = counted.select(
        *key,
        (
            _bit("A", F.col("n") < 200)
            + _bit("B", 100 * F.col("n_distinct") < 50 * F.col("n"))
            + _bit("C", 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 2 * F.char_length("text").cast("long"))
            + _bit("D", F.col("text").rlike("[#$%&*|]"))
        ).alias("fails"),
        F.lit(1).alias("rows"),
    )
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    # One row for each text that a row with a larger id has again.
    firsts = hashed.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    own, other = hashed.alias("own"), firsts.select("hash", "text", "first").alias("other")
    met = (F.col("own.hash") == F.col("other.hash")) & (F.col("own.text") == F.col("other.text")) & (F.col("other.first") < F.col("own.doc_id"))
    repeated = own.join(other, met, "left_semi").select(*key, F.lit(BIT["E"]).alias("fails"), F.lit(0).alias("rows"))
    # Rows alike in the key have one text, so one set of failures; "rows" says how many there are.
    by_id = by_text.unionByName(repeated).groupBy(*key).agg(F.bit_or("fails").alias("fails"), F.sum("rows").alias("rows"))
    return by_id


def combinations(fails: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, good, toxic and rows: how many rows of each part fail together what.

    labels (doc_id, quality, toxic) may lack ids and repeat them; an id is good or toxic if any of its
    labels says 1.
    """
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    slim = fails.groupBy("doc_id", "part", "fails").agg(F.sum("rows").alias("rows"))
    known = slim.join(told, "doc_id", "left").select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "rows")
    return known.groupBy("part", "fails", "good", "toxic").agg(F.sum("rows").alias("rows"))


def interactions(combos: DataFrame) -> DataFrame:
    """One row, zeros included, for each part, order of the filters and step: what the step's filter
    removes, what of its failures earlier steps had removed, and its part in all orders.

    What a step does depends only on the filter and the set of filters before it, so 80 such cases are
    counted for a part and dealt to the 600 steps of all orders.
    """
    code = F.explode(F.sequence(F.lit(0), F.lit(32 * len(FILTERS) - 1))).alias("code")
    cases = combos.select("*", code).select(
        "*", F.floor(F.col("code") / len(FILTERS)).cast("int").alias("before"), F.expr(f"shiftleft(1, code % {len(FILTERS)})").alias("own")
    ).where(F.col("before").bitwiseAND(F.col("own")) == 0)
    failed, earlier = F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    count = lambda when, n=F.col("rows"): F.sum(F.when(when, n).otherwise(0))
    # The first in order of k failed filters removes the row: each of them in 120 / k of the orders.
    share = F.expr(f"rows * ({len(ORDERS)} div bit_count(fails))")
    counted = cases.groupBy("part", "before", "own").agg(
        count(~failed & ~earlier).alias("kept"),
        count(failed & ~earlier).alias("removed"),
        count(failed & earlier).alias("redundant"),
        count(F.col("fails") == F.col("own")).alias("unique_fails"),
        count(failed & ~earlier & F.col("good")).alias("good_lost"),
        count(failed & ~earlier & F.col("toxic")).alias("toxic_lost"),
        count(failed, share).alias("shapley"),
    )
    steps = [(order, k + 1, sum(BIT[x] for x in order[:k]), BIT[order[k]]) for order in ORDERS for k in range(len(order))]
    steps = combos.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")  # always 600 rows
    return counted.join(F.broadcast(steps), ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over documents; see failures, combinations and interactions."""
    return interactions(combinations(failures(docs), labels))
