"""Groups the spelling variants of a corpus's words: words one edit apart, by asymmetric q-chunks.

A word of length L gives two disjoint chunks that make it up. One inserted, deleted or replaced code point
leaves one of them whole in the other word, at its own place if the edit comes after it, moved by the
difference in length (one at most) if the edit comes before. So each word is posted under its two chunks,
as the longer or equal word of a pair, and under the grams of those sizes at those places, as the shorter
one; words meet where a chunk and a gram are the same, and what meets is verified.

Where many words share a chunk, they do not meet there: the part that may hold the edit is halved, and they
are posted again under what each half leaves, the chunk and the other half. This goes on until few share a
key, or the part is one code point: then no two of a key's words of one length share that code point, and
the key has one word that lacks it. No pair is lost on the way, and each is found under one key alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder

#: Keys with more words are split; this bounds how many one word meets, not what is found.
MEET = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, one_in: int = 31) -> DataFrame:
    """word and n, its occurrences in all of docs, of words of at least `shortest` code points and `least`
    occurrences. Runs of letters have A-Z in lower case; where `one_in` divides the crc32 of id, colon and
    run, the run loses the code point at that number modulo its length.

    A null id counts as empty text, null text has no words, repeated rows count each.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), 0)).alias("run")
    ).where(F.char_length("run") >= shortest)
    low = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _keyed(posted: DataFrame) -> DataFrame:
    """With what a word has outside the part that may hold the edit: before "low", and after "high" of
    a word of "long" code points, counted from the end."""
    tail = F.col("long") - F.col("high")
    return posted.withColumn("head", F.substring(F.col("word"), F.lit(1), F.col("low"))).withColumn(
        "tail", F.substring(F.col("word"), F.char_length("word") - tail + 1, tail)
    )


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.explode(F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high"))))


KEY = ["long", "low", "high", "head", "tail"]


def near_pairs(words: DataFrame, folder: str) -> DataFrame:
    """a, n_a, b, n_b of every two words (word, n; distinct) that one edit makes equal, each pair once. folder: a
    shared one for what waits between rounds, which are as many as halvings of the longest crowded part."""
    size = F.char_length("word")
    # Posted as a word of its own length, and as the shorter one of a pair with the next length.
    posted = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("long"))
    posted = posted.select("word", "n", "long", _halves(F.lit(0), F.col("long")).alias("part")).select("word", "n", "long", "part.*")
    pairs, rounds = None, 0
    while True:
        keyed = _keyed(posted)
        n_long = F.sum((F.char_length("word") == F.col("long")).cast("long"))
        # A key needs two words, one of them of the full length.
        counts = keyed.groupBy(*KEY).agg(F.count("*").alias("many"), n_long.alias("n_long")).where("many > 1 and n_long > 0")
        state = _written(keyed.join(counts, KEY).withColumn("meets", (F.col("many") <= MEET) | (F.col("high") - F.col("low") == 1)).select(*posted.columns, "meets"), folder, f"round-{rounds}")
        met = _keyed(state.where("meets"))
        left = met.where(F.char_length("word") == F.col("long")).select(*KEY, F.col("word").alias("a"), F.col("n").alias("n_a"))
        right = met.select(*KEY, F.col("word").alias("b"), F.col("n").alias("n_b"))
        # The edit is where the words first differ, so only one part holds it.
        here = (F.col("high") == F.col("long")) | (F.substring(F.col("a"), F.lit(1), F.col("high")) != F.substring(F.col("b"), F.lit(1), F.col("high")))
        once = (F.char_length("b") < F.col("long")) | (F.col("b") < F.col("a"))
        found = left.join(right, KEY).where(once & here & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")
        pairs = found if pairs is None else pairs.unionByName(found)
        crowded = state.where(~F.col("meets"))
        if crowded.isEmpty():
            return pairs
        posted = crowded.select("word", "n", "long", _halves(F.col("low"), F.col("high")).alias("part")).select("word", "n", "long", "part.*")
        rounds += 1


def _followed(forms: DataFrame, folder: str) -> DataFrame:
    """word and root: the last form that following forms from a word leads to. Each round doubles the way
    that has been gone; forms grow in n by a factor, so ways are short."""
    roots, rounds = _written(forms.select("word", F.col("form").alias("root")), folder, "roots-0"), 0
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        rounds += 1
        further = _written(roots.join(onward, "root", "left"), folder, f"roots-{rounds}")
        roots = further.select("word", F.coalesce("next", "root").alias("root"))
        if further.where("next is not null").isEmpty():
            return roots


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a table (word, n; words distinct).

    form is the near word with the largest n (ties: the smallest in code-point order) where that is at
    least `factor` times the word's n, else null with form_n; root is where following forms ends, the
    word itself without one. An empty table gives no rows. Words are compared as they are, without
    regard to case or accents; other columns are ignored.
    """
    folder = f"{checkpoint_folder(words.sparkSession)}/spelling-{uuid.uuid4()}"
    words = _written(words.select("word", "n"), folder, "words")
    pairs = near_pairs(words, folder)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= factor * F.col("n")
    told = _written(
        told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")),
        folder, "told",
    )
    roots = _followed(told.where("form is not null"), folder)
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
