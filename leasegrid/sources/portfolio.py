"""A portfolio of leases derived from order, line-item and event tables.

Every table has lease_id; ord is the place in a list, where order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leasegrid.functions.money import fix2

BUCKETS = ["cams", "insurance", "taxes", "security", "otherItems"]
NNN = ["cams", "insurance", "taxes"]
LABELS = ["CAMS", "Insurance", "Taxes", "Security", "Other Items"]
#: What charges are called that users add.
ADDED = ["Parking", "Signage", "Storage", "Trash", "Water"]
#: How many leases a task is given, of up to 60 months each.
LEASES_A_PART = 50_000


class Portfolio:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.n_parts = self.parts()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def parts(self) -> int:
        """Into how many parts leases are dealt, by their number, which a file's footers tell. What follows has
        a row for each month and more: dealt by the bytes of the leases alone, a part of them would not
        fit a task's memory."""
        n = -(-self.table("orders").count() // LEASES_A_PART)
        return n if n <= self.spark.sparkContext.defaultParallelism else max(n, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def by_lease(self, rows: DataFrame) -> DataFrame:
        """rows, dealt by lease_id as all tables of the portfolio are."""
        return rows.repartition(self.n_parts, "lease_id")

    def leases(self) -> DataFrame:
        """own_leases(), which no plan is to broadcast: a file of a few MB holds a million leases, which
        are not for the driver."""
        return self.own_leases().hint("merge")

    def own_leases(self) -> DataFrame:
        """lease_id, commence, expire, term, year1, esc, square_footage, nnn_mode, nnn_agg_year1, nnn_agg_esc_pct, analysis_date."""
        key = F.col("o_orderkey")
        commence = F.col("o_orderdate").cast("date")
        term = (12 * (1 + key % 5)).cast("int")
        year1 = fix2(F.col("o_totalprice") / 12)
        return self.table("orders").select(
            key.alias("lease_id"), commence.alias("commence"), term.cast("long").alias("term"),
            F.date_add(F.add_months(commence, term), ((key * 7) % 28 - 1).cast("int")).alias("expire"),
            year1.alias("year1"), ((2 + key % 4) / F.lit(100.0)).alias("esc"), (1000 + (F.col("o_custkey") % 40) * 250).cast("double").alias("square_footage"),
            F.when(key % 4 == 0, "aggregate").otherwise("individual").alias("nnn_mode"),
            fix2(F.col("o_totalprice") / 60).alias("nnn_agg_year1"), F.lit(3.0).alias("nnn_agg_esc_pct"),
            F.date_add(commence, (F.col("o_custkey") % 400).cast("int")).alias("analysis_date"),
            F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"),
        )

    def dealt(self) -> DataFrame:
        """leases(), dealt by lease. A file of many leases is a single task, in which texts of theirs would be
        written and read by one core."""
        return self.by_lease(self.own_leases()).hint("merge")

    def spread(self) -> DataFrame:
        """dealt(), with a part for every core at least where more than one part is dealt: a text takes far
        longer to read than a lease's other values."""
        parts = [max(self.n_parts, self.spark.sparkContext.defaultParallelism)] if self.n_parts > 1 else []
        return self.own_leases().repartition(*parts, "lease_id").hint("merge")

    def charges(self) -> DataFrame:
        """lease_id, ord, key, canonical_type, year1, esc_pct, charge_start; the first of each key."""
        n = (F.col("l_linenumber") - 1) % 5
        first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", F.col("l_shipdate").cast("date").alias("start")))
        # Dealt once, by lease alone, for what is gathered by lease after this.
        own = self.by_lease(self.table("lineitem").select(F.col("l_orderkey").alias("lease_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate"))
        rows = own.groupBy("lease_id", n.cast("int").alias("ord")).agg(first.alias("x"))
        key = F.element_at(F.array(*map(F.lit, BUCKETS)), F.col("ord") + 1)
        return rows.select(
            "lease_id", "ord", key.alias("key"), F.when(key.isin(*NNN), "nnn").otherwise("other").alias("canonical_type"),
            fix2(F.col("x.l_extendedprice") / 100).alias("year1"), (F.col("x.l_discount") * 100).alias("esc_pct"), F.col("x.start").alias("charge_start"),
        )

    def all_charges(self) -> DataFrame:
        """lease_id, ord, key, canonical_type, label, year1, esc_pct, charge_start of every line item. The
        first of each bucket has the bucket's key; of the others, which users have added, one may bring
        the key custom_2 along and the rest have none yet."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate"]
        own = self.by_lease(self.table("lineitem").select(F.col("l_orderkey").alias("lease_id"), *order))
        rows = own.withColumn("n", ((F.col("l_linenumber") - 1) % 5).cast("int"))
        rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("lease_id").orderBy(*order)).cast("long"))
        rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("lease_id", "n").orderBy("ord")) == 1)
        brings = ~F.col("first") & (F.col("l_suppkey") % 4 == 0)
        rows = rows.withColumn("brings", brings & (F.row_number().over(Window.partitionBy("lease_id", brings).orderBy("ord")) == 1))
        pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
        added = F.col("l_partkey") % len(ADDED)
        return rows.select(
            "lease_id", "ord", F.when(F.col("first"), pick(BUCKETS, F.col("n"))).when(F.col("brings"), "custom_2").alias("key"),
            F.when(F.col("first"), F.when(F.col("n") < len(NNN), "nnn").otherwise("other")).otherwise(F.when(added < 2, "nnn").otherwise("other")).alias("canonical_type"),
            F.when(F.col("first"), pick(LABELS, F.col("n"))).otherwise(pick(ADDED, added)).alias("label"),
            fix2(F.col("l_extendedprice") / 100).alias("year1"), (F.col("l_discount") * 100).alias("esc_pct"), F.col("l_shipdate").cast("date").alias("charge_start"),
        )

    def one_time(self) -> DataFrame:
        """lease_id, ord, label, date, amount; undated where ord ends in 9."""
        orders = self.table("orders")
        keys = orders.agg(F.max("o_orderkey").alias("most"))
        rows = self.table("events").crossJoin(F.broadcast(keys)).select(
            (F.col("event_id") % F.col("most") + 1).alias("lease_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"),
            fix2(F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))).alias("amount"),
        )
        starts = self.dealt().select("lease_id", "commence")
        day = F.date_add("commence", ((F.col("ord") * 13) % 2000).cast("int"))
        return rows.where("amount <> 0").join(starts, "lease_id").select("lease_id", "ord", "label", F.when(F.col("ord") % 10 != 9, day).alias("date"), "amount")

    def overrides(self) -> DataFrame:
        """lease_id, ord, target_key, effective_date, amount."""
        def row(where: str, ord_: int, key: str, days: Column, part: float) -> Column:
            return F.when(F.expr(where), F.struct(F.lit(ord_).alias("ord"), F.lit(key).alias("target_key"), F.date_add("commence", days.cast("int")).alias("effective_date"), fix2(F.col("year1") * part).alias("amount")))

        every = F.array_compact(F.array(
            row("priority = '1-URGENT'", 0, "base_rent", F.col("custkey") % 900, 1.25), row("priority = '1-URGENT' and custkey % 2 = 0", 1, "base_rent", F.col("custkey") % 900 + 200, 1.5),
            row("priority = '4-NOT SPECIFIED'", 0, "cams", F.col("custkey") % 700, 0.1),
        ))
        return self.dealt().select("lease_id", F.explode(every).alias("x")).select("lease_id", "x.*")

    def concessions(self) -> DataFrame:
        """lease_id, ord, type, scope, value_mode, value, effective_date, start_date, end_date."""
        none = F.lit(None).cast("date")

        def row(where: str, kind: str, scope: str, mode: str | None, value: Column, day: Column, start: Column, end: Column) -> Column:
            return F.when(F.expr(where), F.struct(
                F.lit(0).alias("ord"), F.lit(kind).alias("type"), F.lit(scope).alias("scope"), F.lit(mode).cast("string").alias("value_mode"),
                value.cast("double").alias("value"), day.alias("effective_date"), start.alias("start_date"), end.alias("end_date"),
            ))

        every = F.array_compact(F.array(
            row("priority = '2-HIGH'", "free_rent", "monthly_row", None, F.lit(100), F.add_months("commence", (F.col("custkey") % 3).cast("int")), none, none),
            row("priority = '3-MEDIUM'", "abatement", "monthly_row", "percent", 25 * (1 + F.col("lease_id") % 3), F.add_months("commence", (F.col("lease_id") % 12).cast("int")), none, none),
            row("priority = '3-MEDIUM' and lease_id % 2 = 0", "abatement", "monthly_row", "fixed_amount", F.lit(500), F.date_add("commence", 45), none, none),
            row("priority = '5-LOW'", "abatement", "legacy_window", "percent", F.lit(50), none, F.col("commence"), F.date_add("commence", (F.col("custkey") % 120).cast("int"))),
        ))
        return self.dealt().select("lease_id", F.explode(every).alias("x")).select("lease_id", "x.*")
