"""Sharding: best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, tasks


class Gaps:
    """Open bins by remaining capacity: a balanced tree of two levels, whose leaves split when full."""

    LEAF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []  # the last entry of every leaf but the final one

    def add(self, room: int, bin_id: int) -> None:
        k = bisect_left(self.tops, (room, bin_id))
        leaf = self.leaves[k]
        insort(leaf, (room, bin_id))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.tops.insert(k, leaf[half - 1])

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest bin with room for size."""
        k = bisect_left(self.tops, (size, -1))
        while k < len(self.leaves):
            leaf = self.leaves[k]
            at = bisect_left(leaf, (size, -1))
            if at < len(leaf):
                return leaf.pop(at)
            k += 1
        return None


def best_fit_decreasing(counts: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs of items into bins: counts are (size, how many) by falling size. Each item goes to the
    tightest bin that has room for it, so like items fill one bin before they go on to the next; a size
    over the capacity has a bin to itself.

    Returns (size, from rank, to rank, bin) and how many bins there are.
    """
    gaps, bins, out = Gaps(), 0, []
    for size, n in counts:
        at = 0
        while at < n:
            if found := gaps.take(size):
                room, b = found
            else:
                room, b, bins = capacity, bins, bins + 1
            many = min(n - at, max(1, room // size))
            out.append((size, at, at + many, b))
            at += many
            if room > many * size:
                gaps.add(room - many * size, b)
    return out, bins


def into_shards(counts: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Items (size, how many; by falling size) into the given number of shards: the least capacity that
    best-fit decreasing keeps to. What is larger than an even share gets a shard to itself; the rest share
    what is left. Returns (size, from rank, to rank, shard)."""
    total, alone, rest, taken = sum(s * n for s, n in counts), [], list(counts), Counter()
    while rest and len(alone) < shards - 1 and rest[0][0] * (shards - len(alone)) > total:
        size, n = rest.pop(0)
        alone.append((size, taken[size], taken[size] + 1, len(alone)))
        taken[size] += 1
        total -= size
        if n > 1:
            rest.insert(0, (size, n - 1))
    left = shards - len(alone)
    if not rest:
        return alone
    low = high = max(rest[0][0], -(-total // left))
    best, used = best_fit_decreasing(rest, high)
    step = max(1, low // 4096)
    while used > left:
        low, high, step = high, high + step, step * 2
        best, used = best_fit_decreasing(rest, high)
    while high - low > max(1, low // 100_000):
        tried, used = best_fit_decreasing(rest, mid := (low + high) // 2)
        low, high, best = (low, mid, tried) if used <= left else (mid, high, best)
    return alone + [(size, a + taken[size], b + taken[size], len(alone) + k) for size, a, b, k in best]


#: Groups with more than this part of the rows meet their rows in a broadcast: a thousand at most.
HOT = 1000


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of near equal bytes; rows of equal text are one group and stay together.

    Groups are range-sorted by falling size, and each enters the tightest bin with room for it. Groups of
    one size are alike, so the plan is made over how many there are of each size, and a group meets it by
    size and rank. Distinct sizes number at most the root of twice all bytes (14 million for 100 TB); only
    these counts reach the driver.

    Null text is the empty text (size 8). Null and repeated ids are kept as rows of their own. An
    empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settled(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
        )
    ).withColumn("at", F.monotonically_increasing_id())
    spark = docs.sparkSession
    order = [F.desc("total"), F.col("group")]
    groups = rows.groupBy("group").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    groups = settled(groups.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)).withColumn("place", F.monotonically_increasing_id())
    groups = groups.withColumn("part", F.shiftright("place", 33))
    counts = groups.groupBy("total", "part").agg(F.count("*").alias("many"), F.min("place").alias("first"))
    sizes = counts.groupBy("total").agg(F.sum("many").alias("many")).orderBy(F.desc("total")).collect()
    plan = spark.createDataFrame(into_shards([tuple(r) for r in sizes], shards), "total long, a long, b long, shard int")
    # A group's rank among its equals: its place in its part, after the equals of earlier parts.
    earlier = Window.partitionBy("total").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("total", "part", "first", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("base"))
    ranked = groups.join(bases, ["total", "part"]).withColumn("rank", F.col("base") + F.col("place") - F.col("first"))
    of_group = settled(ranked.join(plan, "total").where("rank >= a and rank < b").select("group", "n", "shard"))
    hot = F.broadcast(of_group.where(F.col("n") * HOT > rows.count()).select("group", "shard"))
    rest = rows.join(hot, "group", "left_anti").join(of_group.select("group", "shard"), "group")
    placed = settled(rows.join(hot, "group").select(*rest.columns).unionByName(rest)).withColumn("part", F.shiftright("at", 33))
    # A slot is the row's place within its part of the input plus what earlier parts put in the shard.
    by_part = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1
    return (
        placed.withColumn("within", within)
        .join(base, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
