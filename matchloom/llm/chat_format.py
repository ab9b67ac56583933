"""Chat formatting: typed content parts to one training string, DataFrame functions only.

A visitor turns each part of a turn into text: ``text`` parts are escaped, ``image``,
``audio`` and ``document`` parts become placeholders in the order of the parts, and each
placeholder adds a row to the attachment list with its reference and the number of
tokens that it stands for once expanded.

A turn reads ``<|role:ROLE |>TEXT<|end|>``. Inside texts, a backslash goes after the
first character of every control string and every backslash is doubled, so no text can
open or close a turn, and :func:`unescape` restores it exactly.

The loss mask is a list of spans into the UTF-8 bytes of the formatted string: the text
of each assistant turn, without its marks.

Long conversations are built in blocks of turns that are joined afterwards, so rows are
pre-aggregated before a conversation meets in one task; a conversation as a whole is one
value of the result and must fit a row.

Defined cases: null text and null parts are empty, a null role is the empty role, rows of
one conversation with equal turn numbers are ordered by role and text, repeated rows stay,
null conversation ids form one conversation, an empty table gives an empty result, and
columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The control strings that are escaped inside texts.
CONTROL = r"\||/?INST\]|/?s>|</?SYS>>"
#: Tokens that one unit of an attachment stands for (a tile, a second, a page), and those around it.
TOKENS = {"image": (256, 2), "audio": (25, 2), "document": (512, 1)}
TURN_BLOCK = 64
#: A typed content part; ``units`` are tiles, seconds or pages.
PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.IntegerType())])
#: Elements summed up in one go by running sums.
STEP = 128


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?={CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\|"))


def _visit(part: Column) -> Column:
    text = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind in TOKENS:
        text = text.when(part["type"] == kind, F.lit(f"<|{kind}|>"))
    return text.otherwise(F.lit(""))


def _tokens(part: Column) -> Column:
    units, out = F.greatest(F.coalesce(part["units"].cast("long"), F.lit(1)), F.lit(0)), None
    for kind, (each, fixed) in TOKENS.items():
        n = units * each + fixed
        out = F.when(part["type"] == kind, n) if out is None else out.when(part["type"] == kind, n)
    return out.otherwise(F.lit(0))


def format_chats(
    df: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    content_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens``.

    ``content_col`` is a string, which is one ``text`` part, or an array of ``struct<type, text, ref, units>``.
    """
    kind = df.schema[content_col].dataType
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    if not isinstance(kind, T.ArrayType):  # plain texts are turns of one text part
        kind = T.ArrayType(PART)
        plain = {"type": F.lit("text"), "text": F.col(content_col)}
        df = df.withColumn(content_col, F.array(F.struct(*(plain.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART))))
    parts = F.coalesce(F.col(content_col), F.array().cast(kind))
    body = F.array_join(F.transform(parts, _visit), "")
    attached = F.transform(
        F.filter(parts, lambda p: p["type"].isin(*TOKENS)),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).cast("long").alias("tokens")),
    )
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        F.concat(F.lit("<|role:"), escape_role(role), F.lit(" |>")).alias("head"),
        body.alias("body"),
        attached.alias("attached"),
    ).withColumn("piece", F.concat("head", "body", F.lit("<|end|>")))
    one = F.struct(
        "turn",
        "role",
        "body",
        "piece",
        F.octet_length("piece").cast("long").alias("bytes"),
        F.octet_length("head").cast("long").alias("skip"),
        F.octet_length("body").cast("long").alias("len"),
        (F.col("role") == trained_role).cast("int").alias("loss"),
        "attached",
    )
    blocks = (
        turns.groupBy("conv_id", F.floor(F.col("turn") / TURN_BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(one)).alias("t"))
        .select(
            "conv_id",
            F.struct(
                "block",
                F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
                F.size("t").cast("long").alias("n_turns"),
                _spans(F.col("t")).alias("spans"),
                F.flatten(F.transform("t", lambda x: x["attached"])).alias("attached"),
            ).alias("b"),
        )
    )
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    starts = _starts(F.transform("b", lambda x: F.octet_length(x["formatted"]).cast("long")))
    whole = whole.withColumn("starts", starts)
    moved = F.flatten(
        F.zip_with(
            "b",
            "starts",
            lambda x, at: F.transform(x["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["len"].alias("len"))),
        )
    )
    attachments = F.flatten(F.transform("b", lambda x: x["attached"]))
    return whole.select(
        "conv_id",
        F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["n_turns"]).alias("n_turns"),
        F.array_join(F.transform("b", lambda x: x["formatted"]), "").alias("formatted"),
        moved.alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def _starts(lengths: Column) -> Column:
    """Running sum before each element: over steps of the array, then within each, so that long arrays take linear time."""
    zero = F.array(F.lit(0).cast("long"))
    within = lambda x: F.slice(F.aggregate(x, zero, lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y))), 1, F.size(x))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)

    def stepped(x: Column, inner) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda k: F.slice(x, k * STEP + 1, STEP))
        moved = F.zip_with(steps, inner(F.transform(steps, total)), lambda part, at: F.transform(within(part), lambda y: y + at))
        return F.when(F.size(x) > 0, F.flatten(moved)).otherwise(F.array().cast("array<bigint>"))

    return stepped(lengths, lambda x: stepped(x, within))


def _spans(turns: Column) -> Column:
    at = _starts(F.transform(turns, lambda x: x["bytes"]))
    spans = F.zip_with(turns, at, lambda x, s: F.struct((s + x["skip"]).alias("start"), x["len"].alias("len"), x["loss"].alias("loss")))
    return F.transform(F.filter(spans, lambda s: s["loss"] == 1), lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len")))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted string as ``array<struct<role, text>>``; placeholders stay in the text."""
    turns = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda t: F.startswith(t, F.lit("<|role:")))

    def one(turn: Column) -> Column:
        head = F.substring_index(turn, " |>", 1)
        return F.struct(
            unescape(F.substring(head, F.lit(8), F.length(head))).alias("role"),
            unescape(F.substring(turn, F.length(head) + 4, F.length(turn))).alias("text"),
        )

    return F.transform(turns, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    raw = formatted.cast("binary")
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["len"].cast("int")), "UTF-8"))), ""
    )
