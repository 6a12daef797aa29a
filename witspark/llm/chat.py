"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by turn and merged to
blocks of one role; a block is written as

    <s>[INST] role [/INST]
    text<s/>text</s>

where `<s/>` stands between the turns that were merged. Markers inside roles
and texts are escaped with character references, so that `read_back` gives the
turns again exactly.

The result of one conversation is one text, so a conversation must fit into one
row; conversations are independent of each other.

Defined cases: a null text or role is empty; a null conversation id is a
conversation of its own; turns with equal numbers follow role, then text, null
numbers come first; repeated rows are repeated turns; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, HEAD, JOIN, CLOSE = "<s>[INST] ", " [/INST]\n", "<s/>", "</s>"


def escape(text: Column) -> Column:
    """No marker is left in the result; `&` is escaped so that this can be undone."""

    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.regexp_replace(out, r"<(?=/?s>|s/>)", "&lt;")
    return F.regexp_replace(out, r"\[(?=/?INST\])", "&#91;")


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("&#91;"), F.lit("["))
    out = F.replace(out, F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: `conv_id`, `formatted`, `loss_mask`.

    `loss_mask` is an array of (start, chars), 0-based in code points, that covers
    the escaped texts of `learn_role` and nothing else.
    """

    def own(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    collected = (
        turns.select(
            F.col(conv).alias("conv_id"),
            F.struct(F.col(turn).alias("turn"), own(role).alias("role"), own(text).alias("text")).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    starts = collected.select(
        "conv_id",
        "turns",
        F.expr(
            "filter(sequence(0, size(turns) - 1),"
            " i -> i = 0 or turns[i].role != turns[greatest(i - 1, 0)].role)"
        ).alias("starts"),
    )
    # Each block: its role, and its escaped texts as an array.
    blocks = starts.select(
        "conv_id",
        F.transform(
            "starts",
            lambda start, k: F.struct(
                F.element_at("turns", start + 1)["role"].alias("role"),
                F.transform(
                    F.slice(
                        "turns",
                        start + 1,
                        F.coalesce(F.get("starts", k + 1), F.size("turns")) - start,
                    ),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ).alias("blocks"),
    )
    heads = F.transform(
        "blocks",
        lambda b: F.struct(
            F.concat(F.lit(OPEN), escape(b["role"]), F.lit(HEAD)).alias("head"),
            (b["role"] == learn_role).alias("learn"),
            b["texts"].alias("texts"),
        ),
    )
    pieces = blocks.select("conv_id", heads.alias("blocks"))
    formatted = F.array_join(
        F.transform(
            "blocks",
            lambda b: F.concat(b["head"], F.array_join(b["texts"], JOIN), F.lit(CLOSE)),
        ),
        "",
    )
    # The spans of one block, relative to its own start.
    spans = F.transform(
        "blocks",
        lambda b: F.struct(
            F.length(F.concat(b["head"], F.array_join(b["texts"], JOIN), F.lit(CLOSE))).alias("chars"),
            b["learn"].alias("learn"),
            F.length(b["head"]).alias("head"),
            F.transform(b["texts"], lambda x: F.length(x)).alias("sizes"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,chars:bigint>>")

    def walk(array, start, size, mark):
        """(next start, spans so far) over `array`; `mark` adds the spans of one element."""

        return F.aggregate(
            array,
            F.struct(start.cast("bigint").alias("at"), empty.alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + size(x)).cast("bigint").alias("at"),
                F.concat(acc["spans"], mark(acc["at"], x)).alias("spans"),
            ),
        )["spans"]

    def in_block(at, b):
        texts_of = walk(
            b["sizes"],
            at + b["head"],
            lambda n: n + F.lit(len(JOIN)),
            lambda start, n: F.array(
                F.struct(start.cast("bigint").alias("start"), n.cast("bigint").alias("chars"))
            ),
        )
        return F.when(b["learn"], texts_of).otherwise(empty)

    return pieces.select(
        "conv_id",
        formatted.alias("formatted"),
        walk(spans, F.lit(0), lambda b: b["chars"], in_block).alias("loss_mask"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """`conv_id`, `turns` (array of role, text) and `loss_text`, from the output alone."""

    parts = F.split("formatted", CLOSE, -1)
    blocks = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda b: F.struct(
            unescape(F.substring_index(b, HEAD, 1)).alias("head"),
            F.split(
                F.substring(b, F.instr(b, HEAD) + len(HEAD), F.length(b)), JOIN, -1
            ).alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                b["texts"],
                lambda t: F.struct(
                    F.substring(b["head"], F.lit(len(OPEN) + 1), F.length(b["head"])).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )
    learned = F.transform(
        "loss_mask",
        lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["chars"].cast("int"))),
    )
    return chats.select(
        "conv_id", turns.alias("turns"), F.array_join(learned, "").alias("loss_text"), "formatted"
    )
