"""Row-producing operators: rent periods, monthly rows and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import days_inclusive, let, months_inclusive
from leasegrid.functions.money import growth, half_up2


def quick_entry(leases: DataFrame) -> DataFrame:
    """Annual rent periods of leases(lease_id, commence, expire, year1, esc)."""
    years = F.greatest(F.ceil(months_inclusive(F.col("commence"), F.col("expire")) / 12), F.lit(1)).cast("int")
    k = F.col("k")
    return (
        leases.where("expire >= commence")
        .select("lease_id", "commence", "expire", "year1", "esc", F.explode(F.sequence(F.lit(0), years - 1)).alias("k"))
        .select(
            "lease_id", k.cast("long").alias("period_idx"), F.add_months("commence", 12 * k).alias("period_start"),
            F.least(F.date_sub(F.add_months("commence", 12 * (k + 1)), 1), F.col("expire")).alias("period_end"),
            half_up2(growth(F.col("year1"), F.col("esc"), k)).alias("monthly_rent"),
        )
    )


def expand(periods: DataFrame) -> DataFrame:
    """One row per lease and month anchor; of equal dates the last period's row stays. next_start is the
    lease's next anchor.

    Only periods are sorted within their lease, and tell where their months begin and are numbered from; months
    are laid out from them, neither sorted nor dealt. Where periods run into each other a lease's months
    are put in order in one row.
    """
    known = periods.where("period_start is not null and period_end is not null and monthly_rent is not null")
    known = known.withColumn("n", months_inclusive(F.col("period_start"), F.col("period_end"))).where("n > 0")
    order = Window.partitionBy("lease_id").orderBy("period_start", "period_idx")
    lease = Window.partitionBy("lease_id")
    known = known.withColumns({
        "after": F.lead("period_start").over(order), "place": F.row_number().over(order),
        "offset": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
    })
    known = known.withColumn("mixed", F.max(F.add_months("period_start", F.col("n") - 1) >= F.col("after")).over(lease))
    own = F.struct("period_idx", "period_start", "period_end", "monthly_rent", "n")
    # Nulls are not collected: of leases in order the list is empty.
    known = known.withColumn("p", F.collect_list(F.when(F.col("mixed"), own)).over(lease))
    mixed = F.coalesce("mixed", F.lit(False))
    known = known.withColumn("x", F.explode_outer(F.when(mixed & (F.col("place") == 1), in_order("p")))).where(~mixed | F.col("x").isNotNull())
    known = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(mixed, 0).otherwise(F.col("n") - 1))))
    k, last = F.col("k"), F.col("k") == F.col("n") - 1
    plain = {
        "month_start": F.add_months("period_start", k), "explicit_end": F.when(last, F.col("period_end")), "monthly_rent": F.col("monthly_rent"), "period_idx": F.col("period_idx"),
        "source_start": F.col("period_start"), "source_end": F.col("period_end"), "month_num": F.col("offset") + k + 1, "next_start": F.when(last, F.col("after")).otherwise(F.add_months("period_start", k + 1)),
    }
    rows = known.select("lease_id", *[F.when(mixed, F.col(f"x.{c}")).otherwise(v).alias(c) for c, v in plain.items()])
    return rows.withColumn("year_num", F.floor((F.col("month_num") - 1) / 12) + 1)


def in_order(periods: str) -> Column:
    """The months of a list of periods that run into each other, in order and numbered."""
    def month(p: Column, k: Column) -> Column:
        return F.struct(
            F.add_months(p.period_start, k).alias("month_start"), p.period_idx.alias("period_idx"), k.alias("k"), F.when(k == p.n - 1, p.period_end).alias("explicit_end"),
            p.monthly_rent.alias("monthly_rent"), p.period_start.alias("source_start"), p.period_end.alias("source_end"),
        )

    def numbered(m: Column) -> Column:
        # Sorted by date, period and place: of equal dates the last stays, and it is the one whose next differs.
        kept = F.filter(m, lambda x, i: ~F.get(m, i + 1).month_start.eqNullSafe(x.month_start))
        fields = ["month_start", "explicit_end", "monthly_rent", "period_idx", "source_start", "source_end"]
        return let(kept, lambda m: F.transform(m, lambda x, i: F.struct(*[x[c].alias(c) for c in fields], (i + 1).cast("long").alias("month_num"), F.get(m, i + 1).month_start.alias("next_start"))))

    return let(F.array_sort(F.flatten(F.transform(periods, lambda p: F.transform(F.sequence(F.lit(0), p.n - 1), lambda k: month(p, k))))), numbered)


def bounded(months: DataFrame) -> DataFrame:
    """Adds row_end (the day before the next row), is_last and the final month's proration."""
    next_start = F.col("next_start")
    natural = F.date_sub(F.add_months("month_start", 1), 1)
    rows = months.withColumn("is_last", next_start.isNull()).withColumn(
        "row_end", F.coalesce(F.date_sub(next_start, 1), F.col("explicit_end"), natural)
    ).drop("next_start")
    short = F.col("is_last") & (F.col("row_end") < natural)
    actual, calendar = days_inclusive(F.col("month_start"), F.col("row_end")), F.dayofmonth(F.last_day("row_end"))
    return (
        rows.withColumn("actual_days", F.when(short, actual).otherwise(1).cast("long"))
        .withColumn("cal_month_days", F.when(short, calendar).otherwise(1).cast("long"))
        .withColumn("factor", F.when(short, actual / calendar).otherwise(F.lit(1.0)))
    )


def duplicates(periods: DataFrame) -> DataFrame:
    """Dates that more than one period yields."""
    n = months_inclusive(F.col("period_start"), F.col("period_end"))
    rows = periods.withColumn("n", n).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.groupBy("lease_id", F.add_months("period_start", F.col("k")).alias("month_start")).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
