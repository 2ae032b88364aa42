"""Expense labels to buckets: a cascade from exact phrases to fuzzy ones.

The phrase tables are constants of the expressions, so a label is classified where it is read, with no
join; each stage is evaluated only where the stages before it found nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrid.functions import label_tables as T


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with value as a column that is computed once, however many of its fields are read later:
    plans merge neighbouring projections, but not across a generator."""
    return rows.withColumn(name, F.explode(F.array(value)))


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def rewritten(s: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, s)


def expanded(s: Column) -> Column:
    return squeezed(rewritten(s, T.ABBREVIATIONS))


def normalized(raw: Column) -> Column:
    """A label in lower case, abbreviations written out, without punctuation."""
    return squeezed(rewritten(expanded(F.trim(F.lower(F.coalesce(raw, F.lit(""))))), T.PUNCTUATION))


def corrected(s: Column) -> Column:
    """Known misreadings put right."""
    return squeezed(rewritten(s, [(rf"\b{bad}\b", good) for bad, good in T.CORRECTIONS.items()]))


def _bigrams(text: str) -> list[str]:
    return [text[i : i + 2] for i in range(len(text) - 1)]


def bigrams(s: Column) -> Column:
    n = F.length(s)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))


def dice(s: Column, own: Column, text: Column, grams: Column) -> Column:
    """Shared bigrams of two strings, as multisets, twice over their number; own and grams are theirs."""
    count = lambda a, g: F.size(F.filter(a, lambda x: x == g))
    shared = F.aggregate(F.array_distinct(own), F.lit(0), lambda n, g: n + F.least(count(own, g), count(grams, g)))
    short = F.when(F.contains(s, text) | F.contains(text, s), 0.6).otherwise(0.0)
    full = (2 * shared).cast("double") / (F.size(own) + F.size(grams))
    return F.when(s == text, 1.0).when((F.length(s) < 2) | (F.length(text) < 2), short).otherwise(full)


def _table(rows: list[tuple[str, str, str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(-k).alias("place"), F.lit(p).alias("phrase"), F.lit(b).alias("bucket"), F.lit(t).alias("subtype"), F.array(*map(F.lit, _bigrams(p))).cast("array<string>").alias("grams"))
        for k, (p, b, t) in enumerate(rows)
    ])


def nearest(s: Column, own: Column, bucket: Column | None = None) -> Column:
    """The phrase most like s as (score, place, phrase, bucket, subtype); of equals the first. Null if
    nothing is shared with any; bucket restricts the phrases."""
    table = _table(T.PHRASES)
    if bucket is not None:
        table = F.filter(table, lambda p: p.bucket == bucket)
    scored = F.transform(table, lambda p: F.struct(dice(s, own, p.phrase, p.grams).alias("score"), p.place.alias("place"), p.phrase.alias("phrase"), p.bucket.alias("bucket"), p.subtype.alias("subtype")))
    best = F.array_max(scored)
    return F.when(best.score > 0, best)


def exact(s: Column) -> Column:
    """(bucket, subtype) of a phrase, or null."""
    phrases = F.create_map(*[x for p, b, t in T.PHRASES for x in (F.lit(p), F.struct(F.lit(b).alias("bucket"), F.lit(t).alias("subtype")))])
    return F.try_element_at(phrases, s)


def bucket_scores(s: Column) -> list[Column]:
    return [reduce(lambda n, w: n + F.when(F.contains(s, F.lit(w[0])), w[1]).otherwise(0.0), T.WEIGHTS[b], F.lit(0.0)) for b in T.BUCKETS]


def token_result(s: Column) -> Column:
    """(bucket, score, ambiguous) by keyword weights; null below the threshold."""
    scores = F.array(*[F.struct(x.alias("score"), F.lit(-k).alias("place"), F.lit(b).alias("bucket")) for k, (b, x) in enumerate(zip(T.BUCKETS, bucket_scores(s), strict=True))])
    order = F.sort_array(scores, asc=False)
    first, second = F.element_at(order, 1), F.element_at(order, 2)
    found = F.struct(first.bucket.alias("bucket"), first.score.alias("score"), (second.score / first.score >= T.AMBIGUOUS).alias("ambiguous"))
    return F.when(first.score >= T.TOKEN, found)


def rescued(token: Column) -> Column:
    """A token with digits read as letters, where that makes a known word."""
    words = F.array(*map(F.lit, T.VOCABULARY))
    known = lambda x: F.array_contains(words, x)
    single = [F.when(F.contains(token, F.lit(d)) & known(F.replace(token, F.lit(d), F.lit(c))), F.replace(token, F.lit(d), F.lit(c))) for d, c in T.DIGITS]
    whole = F.translate(token, "01354682", "olesagbz")  # every digit by the first letter it stands for
    table = F.array(*[F.struct(F.lit(-k).alias("place"), F.lit(w).alias("word"), F.array(*map(F.lit, _bigrams(w))).alias("grams")) for k, w in enumerate(T.VOCABULARY)])
    near = F.array_max(F.transform(table, lambda w: F.struct(dice(whole, bigrams(whole), w.word, w.grams).alias("score"), w.place.alias("place"), w.word.alias("word"))))
    damaged = ~known(token) & token.rlike("[0-9]") & (F.length(token) <= 20)
    changed = token.rlike("[01345682]")
    found = F.coalesce(*single, F.when(changed & known(whole), whole), F.when(changed & (near.score >= T.RESCUE), near.word), token)
    return F.when(damaged, found).otherwise(token)


def salvaged(s: Column) -> Column:
    clean = squeezed(rewritten(s, [(r"[*#@!$%^&+=~`|\\<>?]{2,}", " "), (r"[*#@!$%^&+=~`|\\<>?]", " ")]))
    return expanded(F.array_join(F.transform(F.filter(F.split(clean, " "), lambda t: t != ""), rescued), " "))


def _stages(labels: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their normalised label ("normal"), and what each stage of the cascade finds for each
    distinct one. A stage is worked out only where those before it decided nothing."""
    rows = labels.withColumn("normal", normalized(F.col(raw)))
    kinds = once(rows.select("normal").distinct(), "working", corrected(F.col("normal")))
    kinds = once(kinds, "e", exact(F.col("normal")))
    kinds = once(kinds, "c", F.when(F.col("e").isNull(), exact(F.col("working"))))
    open_ = F.col("e").isNull() & F.col("c").isNull() & (F.col("normal") != "")
    kinds = kinds.withColumn("open", open_).withColumn("grams", F.when(F.col("open"), bigrams(F.col("working"))))
    kinds = once(kinds, "t", F.when(F.col("open"), token_result(F.col("working"))))
    by_token = F.col("t").isNotNull() & ~F.col("t.ambiguous")
    kinds = once(kinds, "n", F.when(F.col("open") & by_token, nearest(F.col("working"), F.col("grams"), F.col("t.bucket"))).when(F.col("open"), nearest(F.col("working"), F.col("grams"))))
    fuzzy = F.col("open") & ~by_token & (F.col("n.score") >= T.FUZZY)
    kinds = kinds.withColumn("by_token", F.coalesce(by_token, F.lit(False))).withColumn("fuzzy", F.coalesce(fuzzy, F.lit(False)))
    left = F.col("open") & ~F.col("by_token") & ~F.col("fuzzy")
    kinds = once(kinds, "s", F.when(left, salvaged(F.col("working")))).withColumn("s", F.when(F.col("s") != F.col("working"), F.col("s")))
    kinds = once(kinds, "se", exact(F.col("s")))
    kinds = once(kinds, "sn", F.when(F.col("s").isNotNull() & F.col("se").isNull(), nearest(F.col("s"), bigrams(F.col("s")))))
    kinds = once(kinds, "st", F.when(F.col("s").isNotNull() & F.col("se").isNull(), token_result(F.col("s"))))
    return rows, kinds


def trace(labels: DataFrame, raw: str = "raw_label") -> DataFrame:
    """labels with trace: an array of one struct (stage, reads, bucket, score, decides) for each stage of the
    cascade that looked at the label, in order, of which the last decides. reads is what the stage saw,
    bucket and score what it would say, null if nothing."""
    rows, kinds = _stages(labels, raw)
    c = F.col

    def stage(looks: Column, name: str, reads: Column, bucket: Column, score: Column, decides: Column) -> Column:
        own = F.struct(F.lit(name).alias("stage"), reads.alias("reads"), bucket.cast("string").alias("bucket"), F.round(score.cast("double"), 6).alias("score"), F.coalesce(decides, F.lit(False)).alias("decides"))
        return F.when(F.coalesce(looks, F.lit(False)), own)

    given, rescue, none = c("normal") != "", c("s").isNotNull(), F.lit(None)
    later, by_word = rescue & c("se").isNull(), c("st").isNotNull() & ~c("st.ambiguous")
    near = c("sn.score") >= T.FUZZY
    stages = [
        stage(given, "exact", c("normal"), c("e.bucket"), F.when(c("e").isNotNull(), 1.0), c("e").isNotNull()), stage(given & c("e").isNull(), "corrected", c("working"), c("c.bucket"), F.when(c("c").isNotNull(), 1.0), c("c").isNotNull()),
        stage(c("open"), "token", c("working"), c("t.bucket"), c("t.score"), c("by_token")), stage(c("open") & ~c("by_token"), "fuzzy", c("working"), c("n.bucket"), c("n.score"), c("fuzzy")),
        stage(rescue, "salvaged exact", c("s"), c("se.bucket"), F.when(c("se").isNotNull(), 1.0), c("se").isNotNull()), stage(later, "salvaged fuzzy", c("s"), c("sn.bucket"), c("sn.score"), near),
        stage(later & ~F.coalesce(near, F.lit(False)), "salvaged token", c("s"), c("st.bucket"), c("st.score"), by_word),
    ]
    looked = F.array_compact(F.array(*stages))
    last = stage(F.lit(True), "fallback", F.coalesce(c("s"), c("working")), F.lit("otherItems"), none, F.lit(True))
    told = once(kinds, "looked", looked).select("normal", F.when(F.exists("looked", lambda x: x.decides), c("looked")).otherwise(F.concat("looked", F.array(last))).alias("trace"))
    return rows.join(told, "normal").select(*labels.columns, "trace")


def classify(labels: DataFrame, raw: str = "raw_label") -> DataFrame:
    """labels with normalized_label, bucket, subtype, confidence, match_type and matched_canonical.

    Equal labels are classified once: the cascade runs over the distinct normalised labels, and each
    row takes its label's result by a join on it.
    """
    rows, kinds = _stages(labels, raw)
    by_token, fuzzy = F.col("by_token"), F.col("fuzzy")

    def result(label: Column, bucket: Column, subtype: Column, confidence: Column, kind: str, phrase: Column) -> Column:
        return F.struct(label.alias("label"), bucket.alias("bucket"), subtype.cast("string").alias("subtype"), confidence.cast("double").alias("confidence"), F.lit(kind).alias("kind"), phrase.cast("string").alias("phrase"))

    none = F.lit(None)
    found = (
        F.when(F.col("normal") == "", result(F.lit(""), F.lit("otherItems"), none, F.lit(0.0), "fallback", none))
        .when(F.col("e").isNotNull(), result(F.col("normal"), F.col("e.bucket"), F.col("e.subtype"), F.lit(1.0), "exact", F.col("normal")))
        .when(F.col("c").isNotNull(), result(F.col("working"), F.col("c.bucket"), F.col("c.subtype"), F.lit(0.95), "exact", F.col("working")))
        .when(by_token, result(F.col("working"), F.col("t.bucket"), F.when(F.col("n.score") >= T.SUBTYPE, F.col("n.subtype")), F.least(F.lit(0.82), 0.55 + F.col("t.score") * 0.05), "token", F.col("n.phrase")))
        .when(fuzzy, result(F.col("working"), F.col("n.bucket"), F.col("n.subtype"), F.least(F.lit(0.78), F.col("n.score") * 0.88), "fuzzy", F.col("n.phrase")))
        .when(F.col("se").isNotNull(), result(F.col("s"), F.col("se.bucket"), F.col("se.subtype"), F.lit(0.72), "ocr_rescue", F.col("s")))
        .when(F.col("sn.score") >= T.FUZZY, result(F.col("s"), F.col("sn.bucket"), F.col("sn.subtype"), F.least(F.lit(0.62), F.col("sn.score") * 0.75), "ocr_rescue", F.col("sn.phrase")))
        .when(F.col("st").isNotNull() & ~F.col("st.ambiguous"), result(F.col("s"), F.col("st.bucket"), none, F.lit(0.52), "ocr_rescue", none))
        .otherwise(result(F.col("working"), F.lit("otherItems"), none, F.lit(0.25), "fallback", none))
    )
    kinds = kinds.select("normal", found.alias("x"))
    return rows.join(kinds, "normal").drop("normal").select(
        *labels.columns, F.col("x.label").alias("normalized_label"), F.col("x.bucket").alias("bucket"), F.col("x.subtype").alias("subtype"),
        F.round("x.confidence", 6).alias("confidence"), F.col("x.kind").alias("match_type"), F.col("x.phrase").alias("matched_canonical"),
    )
