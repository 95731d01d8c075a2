"""Chat formatting with typed content parts. DataFrame functions only.

Template, for each turn: <turn>ROLE<text>CONTENT</turn> and a line feed. A raw "<" belongs to the template alone: in roles and
texts a backslash is written \\b and "<" is written \\l, which two literal replacements undo. A visitor walks the parts of a turn
in order: text is escaped, and an image, audio or document part becomes <image:K>, <audio:K>, <document:K> (K counts the turn's
attachments from 0), its reference and its expanded token count are recorded; parts of any other kind are <file:K>, without
tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"
PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
#: Expanded tokens: an image has one for each square of IMAGE_PATCH pixels begun, audio so many a second, a document so many a page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as its only part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin("text", "image", "audio", "document"), p["kind"]).otherwise(F.lit("file"))


def _tokens(p: Column) -> Column:
    def patches(side: str) -> Column:
        return F.ceil(F.coalesce(p[side], F.lit(0)) / IMAGE_PATCH)

    return (
        F.when(p["kind"] == "image", patches("width") * patches("height"))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def attachments(parts: Column) -> Column:
    """array<struct<k, kind, ref, tokens>> of a turn's parts that aren't text, in order."""
    files = F.filter(F.coalesce(parts, F.expr(f"CAST(array() AS {PARTS})")), lambda p: _kind(p) != "text")
    return F.transform(files, lambda p, k: F.struct(k.cast("int").alias("k"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))


def content(parts: Column) -> Column:
    """The parts of a turn flattened to one string, in one pass: attachments are first put as <kind:>, and as a raw "<" is theirs
    alone, cutting there numbers them."""
    parts = F.coalesce(parts, F.expr(f"CAST(array() AS {PARTS})"))
    visit = lambda p: F.when(_kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit("<"), _kind(p), F.lit(":>")))
    pieces = F.split(F.array_join(F.transform(parts, visit), ""), "<")

    def number(piece: Column, i: Column) -> Column:
        kind = F.substring_index(piece, ":>", 1)
        rest = F.substr(piece, F.length(kind) + 3)
        return F.when(i == 0, piece).otherwise(F.concat(F.lit("<"), kind, F.lit(":"), (i - 1).cast("string"), F.lit(">"), rest))

    return F.array_join(F.transform(pieces, number), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts) -> one row per conversation: conv_id, formatted, loss_spans (array of start, end; code
    points of formatted, end exclusive: what assistants say), attachments (array of turn, k, kind, ref, tokens), attachment_tokens.

    Turns are in order of turn, nulls first; ties go by role, then content. Null roles and texts count as empty; null parts are no
    parts; a null conv_id is a conversation of its own; repeated rows are repeated turns; an empty table gives an empty one; other
    columns are left out whatever their names. A conversation is one row of the result, so its turns meet in one task, where they
    are sorted with spilling."""
    x = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content(F.col("parts")).alias("content"), attachments(F.col("parts")).alias("files"))
    x = x.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)))
    x = x.withColumn("piece", F.concat("head", "content", F.lit(CLOSE)))
    x = x.repartition("conv_id").withColumn("raw", unescape(F.col("content")))  # sorted by as it was said; made after the shuffle
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    x = x.withColumn("nth", F.row_number().over(order))
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("start", before + F.length("head"))
    x = x.withColumn("span", F.when(F.col("role") == "assistant", F.struct("start", (F.col("start") + F.length("content")).alias("end"))))
    files = F.transform("files", lambda f: F.struct(F.col("turn").alias("turn"), f["k"].alias("k"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))
    grouped = x.withColumn("files", files).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "piece", "span", "files"))).alias("t"))
    out = grouped.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("t.files")).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders are left out of texts."""
    turns = F.split(formatted, r"</turn>\n")
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def parse(t: Column) -> Column:
        role = F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MIDDLE, 1)
        said = F.substr(t, F.lit(len(OPEN) + len(MIDDLE) + 1) + F.length(role))
        return F.struct(unescape(role).alias("role"), unescape(F.regexp_replace(said, "<[a-z]+:[0-9]+>", "")).alias("text"))

    return F.transform(turns, parse)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(cut, lambda t: unescape(F.regexp_replace(t, "<[a-z]+:[0-9]+>", ""))), "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from formatted and loss_spans."""
    x = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
