"""Charges that users define: keys of their own, and tables whose columns the data decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollup import cents

#: A table has at most so many columns of charges; with more labels they are one map.
MOST_COLUMNS = 64
NNN_COMBINED = "NNN Combined ($)"


def keyed(charges: DataFrame) -> DataFrame:
    """charges(lease_id, ord, key, ...) with a key for those that have none: custom_N, in order, N being
    the least numbers that no charge of the lease has yet.

    The n-th free number is n and as many taken ones as have fewer than n free ones below them: a running
    count over both in one order, whatever a lease has.
    """
    number = F.regexp_extract(F.coalesce("key", F.lit("")), r"^custom_(\d+)$", 1).try_cast("long")
    rows = charges.withColumn("number", number).withColumn("kind", F.when(F.col("key").isNull(), "new").when(F.col("number").isNotNull(), "taken").otherwise("own"))
    place = F.row_number().over(Window.partitionBy("lease_id", "kind").orderBy("number", "ord"))
    rows = rows.withColumn("at", F.when(F.col("kind") == "new", place).when(F.col("kind") == "taken", F.col("number") - place))
    order = Window.partitionBy("lease_id").orderBy("at", F.col("kind") == "taken", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.count(F.when(F.col("kind") == "taken", 1)).over(order)
    key = F.when(F.col("kind") == "new", F.concat(F.lit("custom_"), (F.col("at") + taken).cast("string"))).otherwise(F.col("key"))
    return rows.withColumn("key", key).select(*charges.columns)


def active(amounts: DataFrame, charges: DataFrame, leases: DataFrame) -> DataFrame:
    """lease_id, key, canonical_type, label, nnn_mode of the charges that a schedule shows: those with an
    amount in some month or in their terms; in aggregate mode no net ones by themselves."""
    seen = amounts.groupBy("lease_id", "key").agg(F.bool_or(F.col("amount") != 0).alias("seen"))
    own = charges.join(leases.select("lease_id", "nnn_mode"), "lease_id").where("not (nnn_mode = 'aggregate' and canonical_type = 'nnn')")
    return own.join(seen, ["lease_id", "key"], "left").where("coalesce(seen, false) or year1 > 0").select("lease_id", "key", "canonical_type", "label", "nnn_mode")


def titled(canonical_type: Column, label: Column, both: Column) -> Column:
    """A column's title; a label that net and other charges share tells which it is."""
    return F.concat(label, F.when(both & (canonical_type == "nnn"), " (NNN)").otherwise(""), F.lit(" ($)"))


def titles(labels: DataFrame) -> DataFrame:
    """canonical_type, label, title of each column that labels(canonical_type, label) make."""
    own = labels.groupBy("label").agg(F.collect_set("canonical_type").alias("kinds")).select("label", F.explode("kinds").alias("canonical_type"), (F.size("kinds") > 1).alias("both"))
    return own.select("canonical_type", "label", titled(F.col("canonical_type"), F.col("label"), F.col("both")).alias("title"))


def found_titles(titles_: DataFrame, most: int = MOST_COLUMNS) -> dict[tuple[str, str], str] | None:
    """The title of each kind and label, net charges first, each kind by name; none of them if they are more
    than most, of which most + 1 reach the driver."""
    found = titles_.orderBy(F.col("canonical_type") != "nnn", "title").limit(most + 1).collect()
    return {(r.canonical_type, r.label): r.title for r in found} if len(found) <= most else None


def wide(amounts: DataFrame, labels: DataFrame, most: int = MOST_COLUMNS) -> tuple[DataFrame, list[str]]:
    """amounts(lease_id, month_num, canonical_type, label, amount) as a row for each lease and month, with
    a column for each label: net charges first, each kind by name. Two passes: which labels there are (of
    labels(canonical_type, label), at most most + 1 reach the driver), and the sums. With more labels one column "charges" maps
    titles to sums. Returns the table and the names of its columns of charges."""
    every = titles(labels)
    names = found_titles(every, most)
    if names is not None:
        is_ = lambda kind, label: (F.col("canonical_type") == kind) & (F.col("label") == label)
        sums = [F.when(F.count_if(is_(*of)) > 0, cents(F.when(is_(*of), F.col("amount")))).alias(title) for of, title in names.items()]
        empty = [F.count("*").alias("n")] if not sums else []
        return amounts.groupBy("lease_id", "month_num").agg(*sums, *empty).drop("n"), list(names.values())
    sums = amounts.join(every, ["canonical_type", "label"]).groupBy("lease_id", "month_num", "title").agg(cents("amount").alias("amount"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("title", "amount"))))
    return sums.groupBy("lease_id", "month_num").agg(entries.alias("charges")), ["charges"]


# The titles of a schedule's other columns, before and after those of charges.
HEAD = {
    "period_start": "Period Start", "period_end": "Period End", "year_num": "Lease Year #", "month_num": "Lease Month #",
    "scheduled_base_rent": "Scheduled Base Rent ($)", "base_rent_applied": "Base Rent Applied ($)",
}
TAIL = {
    "one_time_charges_amount": "One-time Charges ($)", "total_monthly_obligation": "Total Monthly Obligation ($)", "effective_per_sf": "Effective $/SF",
    "total_obligation_remaining": "Total Obligation Remaining ($)", "total_base_rent_remaining": "Base Rent Remaining ($)",
    "total_nnn_remaining": "NNN Remaining ($)", "total_other_charges_remaining": "Other Charges Remaining ($)",
}


def schedule_columns(rows: DataFrame, names: list[str], mode: str) -> DataFrame:
    """rows of a mode as they are exported, with the columns names of its charges."""
    combined = [F.col("total_nnn_amount").alias(NNN_COMBINED)] if mode == "aggregate" else []
    return rows.select("lease_id", *[F.col(c).alias(t) for c, t in HEAD.items()], *combined, *[F.col(f"`{n}`") for n in names], *[F.col(c).alias(t) for c, t in TAIL.items()])


def schedule_table(rows: DataFrame, amounts: DataFrame, shown: DataFrame, mode: str, most: int = MOST_COLUMNS) -> DataFrame:
    """The schedule of all leases of a mode as it is exported: rows (the ledger with what remains), with a
    column for each label of shown (as active() has them) and, in aggregate mode, one for all net charges
    together in place of theirs. A charge that a lease does not have is null."""
    own = rows.where(F.col("nnn_mode") == mode)
    shown = shown.where(F.col("nnn_mode") == mode).select("lease_id", "key", "canonical_type", "label")
    told = amounts.select("lease_id", "month_num", "key", "amount").join(shown, ["lease_id", "key"])
    columns, names = wide(told, shown, most)
    return schedule_columns(own.join(columns, ["lease_id", "month_num"], "left"), names, mode)


def charge_totals(amounts: DataFrame, charges: DataFrame) -> DataFrame:
    """lease_id, key, label, canonical_type, total, n_months (with an amount), first_month of each charge."""
    sums = amounts.groupBy("lease_id", "key").agg(cents("amount").alias("total"), F.count_if(F.col("amount") != 0).alias("n_months"), F.min(F.when(F.col("amount") != 0, F.col("month_num"))).alias("first_month"))
    return sums.join(charges.select("lease_id", "key", "label", "canonical_type"), ["lease_id", "key"])
