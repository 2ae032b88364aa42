"""Dates of a lease's events: what several sources say, and what follows from rules over other events.

A lease has few events, as EVENTS lists all there are. So each lease is one row whose dates and rules are
arrays by event, and resolution to a fixed point is a bounded number of passes over these arrays inside the
row: no round trips between tables, and one shuffle by lease.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EVENTS, resolved

NAMES = list(EVENTS)
PAIRED = ["later_of", "earlier_of"]
RULE = "struct<rule_kind: string, first: int, second: int, fallback: int, offset: int>"


def merged(sources: list[DataFrame]) -> DataFrame:
    """lease_id, event, day, source of each event: of sources (lease_id, event, day) the first that knows
    it; within one source the earliest day. Unknown names and null days are left out."""
    rows = reduce(DataFrame.unionByName, [s.select("lease_id", "event", "day", F.lit(k).alias("source")) for k, s in enumerate(sources)])
    return rows.where(F.col("day").isNotNull() & F.col("event").isin(*NAMES)).groupBy("lease_id", "event").agg(F.min(F.struct("source", "day")).alias("x")).select("lease_id", "event", "x.day", "x.source")


def _number(event: str) -> Column:
    """An event's place in the arrays, from 1; null for none or an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, NAMES)), F.col(event)), F.lit(0)).cast("int")


def resolve(known: DataFrame, rules: DataFrame) -> DataFrame:
    """lease_id, event, day, state, open of every event that is known or that a rule defines.

    known(lease_id, event, day) holds one day an event. rules(lease_id, ord, event, rule_kind,
    trigger_event, second_event, fallback_event, offset_value) define others; a known event needs none, and
    of several rules for one event the first counts. A rule waits for its triggers as long as they may
    still come: when they cannot, because nothing defines them, a pair goes by the one that is there and
    another rule by its fallback, if there is one. What waits only for events that wait for each other
    goes by what it has in the end.

    state: "known", "resolved", "cycle" (the event depends on itself) or "missing"; open lists the
    triggers that have no day, in the order of the rule.
    """
    n = len(NAMES)
    dated = known.select("lease_id", _number("event").alias("at"), "day").where("at is not null")
    first = rules.withColumn("at", _number("event")).where("at is not null").groupBy("lease_id", "at").agg(
        F.min_by(F.struct("rule_kind", _number("trigger_event").alias("first"), _number("second_event").alias("second"), _number("fallback_event").alias("fallback"), F.col("offset_value").cast("int").alias("offset")), "ord").alias("rule")
    )
    every = dated.select("lease_id", "at", "day", F.lit(None).cast(RULE).alias("rule")).unionByName(first.select("lease_id", "at", F.lit(None).cast("date").alias("day"), F.col("rule").cast(RULE).alias("rule")))
    own = lambda k, value: F.max_by(value, F.when((F.col("at") == k) & F.col(value).isNotNull(), 1))
    rows = every.groupBy("lease_id").agg(F.array(*[own(k + 1, "day") for k in range(n)]).alias("given"), F.array(*[own(k + 1, "rule") for k in range(n)]).alias("rules"))

    places = F.sequence(F.lit(1), F.lit(n))
    at = lambda array, k: F.when(k.isNotNull(), F.try_element_at(array, k))
    rule = lambda k: F.element_at("rules", k)
    triggers = lambda r: F.array_compact(F.array(r.first, F.when(r.rule_kind.isin(*PAIRED), r.second)))

    def day_of(k: Column, days: Column, patient: bool) -> Column:
        r = rule(k)
        lacking = F.filter(triggers(r), lambda t: F.element_at(days, t).isNull())
        waits = F.exists(lacking, lambda t: rule(t).isNotNull())
        main = F.when(r.rule_kind.isin(*PAIRED), at(days, r.first)).otherwise(F.coalesce(at(days, r.first), at(days, r.fallback)))
        day = resolved(r.rule_kind, main, at(days, r.second), F.coalesce(r.offset, F.lit(0)))
        return F.coalesce(F.element_at(days, k), F.when(~waits, day) if patient else day)

    def passes(days: Column) -> Column:
        """A chain of events has at most n links, so n passes reach its end."""
        return F.aggregate(places, days, lambda so_far, _: F.transform(places, lambda k: day_of(k, so_far, True)))

    rows = rows.withColumn("settled", passes(F.col("given")))
    rows = rows.withColumn("forced", F.transform(places, lambda k: day_of(k, F.col("settled"), False))).withColumn("days", passes(F.col("forced")))
    # Which events an open one leads to through open ones, as bits; a bit of its own tells a cycle.
    bit = lambda t: F.element_at(F.array(*[F.lit(1 << k) for k in range(n)]), t)
    lead = lambda k, reach: F.aggregate(F.filter(triggers(rule(k)), lambda t: F.element_at("days", t).isNull()), F.lit(0), lambda m, t: m.bitwiseOR(bit(t)).bitwiseOR(F.element_at(reach, t)))
    reach = F.aggregate(places, F.transform(places, lambda k: F.lit(0)), lambda m, _: F.transform(places, lambda k: F.coalesce(lead(k, m), F.lit(0))))
    rows = rows.withColumn("reach", reach)
    told = F.transform(
        places,
        lambda k: F.struct(
            F.element_at(F.array(*map(F.lit, NAMES)), k).alias("event"), F.element_at("days", k).alias("day"),
            F.when(F.element_at("given", k).isNotNull(), "known").when(F.element_at("days", k).isNotNull(), "resolved")
            .when(F.element_at("reach", k).bitwiseAND(bit(k)) != 0, "cycle").otherwise("missing").alias("state"),
            F.transform(F.filter(F.coalesce(F.when(F.element_at("given", k).isNull(), triggers(rule(k))), F.array().cast("array<int>")), lambda t: F.element_at("days", t).isNull()), lambda t: F.element_at(F.array(*map(F.lit, NAMES)), t)).alias("open"),
            (F.element_at("given", k).isNotNull() | rule(k).isNotNull()).alias("named"),
        ),
    )
    return rows.select("lease_id", F.explode(told).alias("x")).where("x.named").select("lease_id", "x.event", "x.day", "x.state", "x.open")
