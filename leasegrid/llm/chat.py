"""Chat formatting: typed content parts flattened into one marked-up text per conversation.

Only DataFrame functions are used. A turn is written

    <|im_start|>role newline text<|im_end|> newline

In every text, each "<", any number of backslashes and "|" gets one more backslash after the "<", so
no text can hold a control string; taking one backslash away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: A content part. Sizes: width and height in pixels, seconds of audio, pages of a document.
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 258


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def expanded_tokens(part: Column) -> Column:
    """How many tokens a model puts in a placeholder's place; 0 for text and for unknown sizes."""
    side = lambda n: F.ceil(n / F.lit(PATCH))
    size = (
        F.when(part.kind == "image", side(part.width) * side(part.height))
        .when(part.kind == "audio", F.ceil(part.seconds * AUDIO_RATE))
        .when(part.kind == "document", part.pages.cast("long") * PAGE_TOKENS)
    )
    return F.coalesce(size, F.lit(0)).cast("long")


def visit(part: Column) -> Column:
    """What a part becomes in the text: its escaped text, or a placeholder for an attachment."""
    other = F.concat(F.lit("<|"), F.regexp_replace(F.coalesce(part.kind, F.lit("unknown")), "[^a-z_]", "_"), F.lit("|>"))
    return F.when(part.kind == "text", escape(F.coalesce(part.text, F.lit("")))).otherwise(other)


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts).

    Returns conv_id; formatted, the text; loss_spans, an array of (turn_no, start, length): places
    in code points from the start of that turn's segment, for the turns whose role is trained;
    attachments, an array of (turn_no, part_no, kind, ref, tokens) in order; expanded_tokens, their
    sum. turn_no counts turns from 0.

    Turns are ordered by turn, then role, then parts, as they are before any escaping; null turns come
    first; null roles and null part texts are empty; null or empty parts make an empty turn; repeated
    rows are turns of their own. A conversation is one training sample, so its turns meet in one row,
    as its text must; a null conv_id is a conversation as any other. Other columns are ignored. No rows
    give no rows.
    """
    raw = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")).alias("parts"))
    attached = lambda parts: F.filter(
        F.transform(parts, lambda p, i: F.struct(i.alias("part_no"), p.kind.alias("kind"), p.ref.alias("ref"), expanded_tokens(p).alias("tokens"))),
        lambda a: ~a.kind.eqNullSafe("text"),
    )
    written = lambda t: F.struct(
        F.regexp_replace(escape(t.role), "\n", NEWLINE).alias("role"),
        F.array_join(F.transform(t.parts, visit), "").alias("body"),
        t.role.isin(*trained).alias("loss"),
        attached(t.parts).alias("attached"),
    )
    grouped = turns.select("conv_id", raw.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("raw")).select("conv_id", F.transform("raw", written).alias("ts"))
    segment = lambda t: F.concat(F.lit(START), t.role, F.lit("\n"), t.body, F.lit(END + "\n"))
    span = lambda t, i: F.struct(
        i.cast("long").alias("turn_no"),
        (F.char_length(t.role) + len(START) + 2).cast("long").alias("start"),
        F.char_length(t.body).cast("long").alias("length"),
        t.loss.alias("loss"),
    )
    spans = F.transform(
        F.filter(F.transform("ts", span), lambda s: s.loss), lambda s: F.struct(s.turn_no.alias("turn_no"), s.start.alias("start"), s.length.alias("length"))
    )
    attachments = F.flatten(
        F.transform(
            "ts",
            lambda t, i: F.transform(
                t.attached,
                lambda a: F.struct(i.cast("long").alias("turn_no"), a.part_no.cast("long").alias("part_no"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens")),
            ),
        )
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("ts", segment), "").alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a.tokens).alias("expanded_tokens"),
    )


def segments(formatted: Column) -> Column:
    """The turns of a formatted text, each from its start mark to the next."""
    marked = F.split(formatted, r"(?=<\|im_start\|>)")
    return F.filter(marked, lambda s: s != "")


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a formatted text."""

    def turn(segment: Column) -> Column:
        role = F.substring_index(F.substring(segment, len(START) + 1, 1 << 30), "\n", 1)
        body = F.substring(segment, F.char_length(role) + len(START) + 2, F.char_length(segment) - F.char_length(role) - len(START) - 2 - len(END))
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(segments(formatted), turn)


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, read back from a formatted text."""
    of = segments(formatted)
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(F.element_at(of, (s.turn_no + 1).cast("int")), s.start.cast("int"), s.length.cast("int")))), "")
