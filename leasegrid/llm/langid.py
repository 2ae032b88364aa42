"""Language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, tidy

ORDERS = (1, 2, 3)
PROFILE = 400
UNDETERMINED = "und"
#: A text that shares less than this with every language's profile is in none of them; to tell, it has
#: to have so many different n-grams.
LEAST_SCORE, LEAST_GRAMS = 0.25, 30
_EDGE = 1  # stands for the border of a word

#: Letters by code point up to U+FFFF, as small numbers in lower case; 0 is not a letter.
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text's letters, words bordered, as numbers of 21 bits a letter, and
    their counts. No letters: none."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    on = codes > 0
    if not on.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Each run of other characters becomes one border.
    keep = on | np.r_[True, on[:-1]]
    line = np.where(on, codes, _EDGE)[keep].astype(np.uint64)
    if line[0] != _EDGE:
        line = np.r_[np.uint64(_EDGE), line]
    if line[-1] != _EDGE:
        line = np.r_[line, np.uint64(_EDGE)]
    found, code = [], line
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            code = (code[:-1] << np.uint64(21)) | line[n - 1 :]
        if n in ORDERS:
            # A border stands at the ends of an n-gram only, and never alone.
            fine = np.ones(len(code), bool) if n > 1 else line != _EDGE
            for k in range(1, n - 1):
                fine &= line[k : k + len(code)] != _EDGE
            found.append(code[fine])
    every = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[first], np.diff(np.r_[first, len(every)])


def ranked(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent values in order, ties to the smaller value."""
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        kept = counts >= least
        values, counts = values[kept], counts[kept]
    return values[np.lexsort((values, -counts))][:most]


class Profiles:
    """For each language, its most frequent n-grams by rank."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.langs = sorted(rows["lang"].unique())
        self.grams, self.ranks = [], []
        for lang in self.langs:
            own = rows[rows["lang"] == lang].sort_values("gram")
            self.grams.append(own["gram"].to_numpy(np.int64).view(np.uint64))
            self.ranks.append(own["rank"].to_numpy(np.int64))

    def predict(self, text: str | None, most: int = PROFILE) -> tuple[str, float, int]:
        """The language at the least out-of-place distance; how far it is from the greatest possible
        one, from 0 (nothing in common) to 1; and how many n-grams were compared."""
        top = ranked(*grams(text or ""), most)
        if not len(top) or not self.langs:
            return UNDETERMINED, 0.0, len(top)
        place, distances = np.arange(len(top)), []
        for own, ranks in zip(self.grams, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(own, top), len(own) - 1)
            distances.append(np.where(own[at] == top, np.minimum(np.abs(ranks[at] - place), most), most).sum())
        best = int(np.argmin(distances))
        return self.langs[best], float(1 - distances[best] / (most * len(top))), len(top)

    def accepted(self, text: str | None) -> str | None:
        """The language of a text that is to stay, None for one that is to go. Without profiles no
        text can be told apart, so all that have letters stay as undetermined."""
        lang, score, n = self.predict(text)
        if not n or (self.langs and n >= LEAST_GRAMS and score < LEAST_SCORE):
            return None
        return lang


def learn(docs: DataFrame, most: int = PROFILE) -> pd.DataFrame:
    """lang, gram, rank of each language's profile, from all rows with a lang and a text.

    Every task adds up its own rows first, so what is shuffled is one count a task, language and
    n-gram; at most `most` rows a language reach the driver.
    """
    rows = docs.select("lang", "text").where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in chunks(batch, limit=1 << 18):
                new: dict[str, list] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    new.setdefault(lang, []).append(grams(text))
                for lang, own in new.items():
                    old = [sums[lang]] if lang in sums else []
                    values, counts = (np.concatenate(x) for x in zip(*own, *old, strict=True))
                    distinct, inverse = np.unique(values, return_inverse=True)
                    sums[lang] = distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        tidy()
        for lang, (values, counts) in sums.items():
            for at in range(0, len(values), 50_000):
                v, n = values[at : at + 50_000], counts[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(v.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    totals = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # In this form Spark cuts each partition to its first rows before it deals them by language.
    first = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return first.select("lang", "gram", (F.col("rank") - 1).alias("rank")).toPandas()


def identify(docs: DataFrame, profiles: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, by its whole text alone.

    The distance is the sum, over the text's most frequent n-grams, of how far each is out of its
    place in a language's profile; the least wins, ties go to the first language in order. A null
    text and one without letters is `und` with score 0, and so is any text if nothing was learned.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def with_language(docs: DataFrame, profiles: pd.DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text is in one of the profiles' languages; a null lang becomes that one.

    Null texts, texts without letters, and texts of LEAST_GRAMS n-grams or more that share under
    LEAST_SCORE with every profile go; shorter ones have too little to tell by and stay. A lang that is
    given is kept as it is. With no profiles all texts with letters stay, and a null lang stays null.
    Repeated rows stay or go alike; other columns are returned as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tidy()
            for part in chunks(batch, text_col):
                found = [shared.value.accepted(t.as_py()) for t in part.column(part.schema.get_field_index(text_col))]
                at = part.schema.get_field_index(lang_col)
                if at >= 0 and part.column(at).null_count:
                    own = [f if x is None and f != UNDETERMINED else x for x, f in zip(part.column(at).to_pylist(), found, strict=True)]
                    part = part.set_column(at, part.schema.field(at), pa.array(own, part.schema.field(at).type))
                yield part.filter(pa.array([f is not None for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
