"""Tables out of text that is only placed on pages: lines from coordinates, columns from a line of headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import parse_cell

from .tables import HEADERS


def laid_out(glyphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line, cells: glyphs(key, page, x, y, ord, str) as the lines that they stand in, of whole documents.

    What is at the same height, to the nearest unit, is a line, and pages are read from the top; in a line
    pieces go by their place from the left (ties: ord). Blank pieces are none, and lines of blanks are left
    out. A line is what a page holds side by side, so it is gathered in one row.
    """
    row = F.floor(F.col("y") + 0.5).alias("row")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", F.trim("str").alias("text")))), lambda g: g.text)
    lines = glyphs.where("trim(str) <> ''").groupBy(key, "page", row).agg(cells.alias("cells"))
    order = Window.partitionBy(key).orderBy("page", F.desc("row"))
    return lines.select(key, F.row_number().over(order).cast("long").alias("line"), "cells")


def columns_of(headers: Column) -> Column:
    """Where each column of a rent table is among the headers: places from 1, null where there is none."""
    plain = F.transform(headers, lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))
    place = lambda patterns: F.nullif(F.array_position(F.transform(plain, lambda h: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(h, p))), F.lit(True)), F.lit(0)).cast("int")
    return F.struct(*[place(patterns).alias(column) for column, patterns in HEADERS.items()])


def rent_tables(lines: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Periods (key, line, period_start, period_end, monthly_rent) of documents whose first line names the
    columns, and warnings (key, line, message): a document without all three columns has no periods and is
    warned of at line 0, as is one without other lines; lines without two dates and a number are warned
    of. A blank rent counts as 0."""
    of_doc = Window.partitionBy(key).orderBy("line")
    rows = lines.withColumn("places", F.first(F.when(F.col("line") == 1, columns_of(F.col("cells"))), ignorenulls=True).over(of_doc))
    found = F.col("places.period_start").isNotNull() & F.col("places.period_end").isNotNull() & F.col("places.monthly_rent").isNotNull()
    rows = rows.withColumn("found", found).withColumn("n_lines", F.count("*").over(Window.partitionBy(key)))
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.col(f"places.{c}")), F.lit(""))
    body = rows.where("line > 1 and found").select(
        key, "line", parse_cell(cell("period_start")).alias("period_start"), parse_cell(cell("period_end")).alias("period_end"),
        F.when(cell("monthly_rent") == "", 0.0).otherwise(F.regexp_replace(cell("monthly_rent"), "[$,]", "").try_cast("double")).alias("monthly_rent"),
    )
    good = "period_start is not null and period_end is not null and monthly_rent is not null"
    head = rows.where("line = 1").select(key, F.lit(0).cast("long").alias("line"), F.when(~F.col("found"), "the columns of a rent table are not there").when(F.col("n_lines") == 1, "there are no lines under the headers").alias("message"))
    skipped = body.where(f"not ({good})").select(key, "line", F.lit("line skipped: it lacks a start, an end or a rent").alias("message"))
    return body.where(good), head.where("message is not null").unionByName(skipped)
