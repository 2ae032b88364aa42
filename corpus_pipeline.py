"""A training corpus from raw documents: five stages, each one operator over all that the last one kept.

Every stage takes (spark, docs, sf_dir), where docs has the columns of documents, and all but the last
return these columns. run() writes each stage's rows as Parquet in the shared checkpoint folder and
reads them again, so a lost executor costs no more than its tasks of one stage. An empty table goes
through all stages and gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrid.llm import decontaminate, langid, packing, simhash, suffix
from leasegrid.llm.common import checkpoint_folder
from leasegrid.llm.queries import tokenizer_path

SEQUENCE = 2048


def columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is in none of the languages that rows with a lang are in: null texts, texts without
    letters, and texts whose n-grams no language's profile has. A null lang of the others becomes the
    predicted one. With no lang in the table all texts with letters stay. Repeated rows stay or go alike."""
    return langid.with_language(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies, fingerprints at most 2 bits apart, the row with the smallest
    doc_id; a null doc_id is larger than all others. Rows of one doc_id and text count as repeated and
    leave one, the least by its other columns; of one doc_id with several texts in a group, the least
    digest of the text. Null and blank texts are near copies of each other."""
    text = F.concat_ws("|", F.col("doc_id").cast("string"), F.when(F.col("text").isNull(), "0").otherwise("1"), "text")
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*columns(others)).alias("row"), "doc_id", "text", F.sha2(text, 256).alias("key"))
    found = simhash.near_duplicates(keyed.select(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key").alias("id"), "text"), id_col="id")
    kept = found.where("doc_id = component_id").select("doc_id.key")
    # Repeated rows, by their texts and not by the digest, become one in the task that reads them; the join
    # keeps how the rest is dealt.
    once = keyed.groupBy("key", "text").agg(F.min("row").alias("row"))
    return once.join(kept, "key", "left_semi").select("row.*", "text").select(*columns(docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller doc_id has; what is left of a cut character goes
    too, and so do documents of which nothing is left. n_chars is that of the new text. Null and empty
    texts stay, as empty ones; rows of one doc_id take nothing from each other; a null doc_id is larger
    than all others."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix.dedup(docs.select("doc_id", "text", F.struct(*columns(others)).alias("others")), carry="others", as_text=True)
    n_chars = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    kept = out.where((F.col("n_bytes") == 0) | (F.col("kept") != "")).select("doc_id", F.col("kept").alias("text"), "carried.*", n_chars.alias("n_chars"))
    return kept.select(*columns(docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null and empty texts hold none and stay,
    repeated rows stay or go alike, and an empty benchmark drops nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences: doc_id, piece, start, length,
    ids_crc32, sequence_id and offset. A null or empty text is a piece that holds the closing id alone;
    repeated rows have pieces of their own."""
    return packing.pack_documents(docs, tokenizer_path(), SEQUENCE)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark_free", benchmark_free),
    ("sequences", sequences),
]
#: The stages are beyond SQL (language profiles, XXH64 fingerprints, tokenizers); tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
