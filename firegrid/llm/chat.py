"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
text is trainable. Built from Spark expressions alone.

Template of a turn: ``<s>`` role ``[INST]`` text ``</s>``. A control string inside a role or a text gets a
backslash after its first character, and a backslash is doubled, so reading back is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<s>", "[INST]", "</s>"
# fixed values: the control strings of the template family
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Text in which no control string is left."""
    start = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:])), CONTROL, start)


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, n_turns, formatted, loss_start, loss_end, trainable``.

    ``formatted`` holds all turns up to and with the reply; the half-open range of code points
    ``loss_start``..``loss_end`` of it is trainable. If turns follow the last reply, a closing example with
    ``trainable`` false and an empty range holds them, so no turn is lost.

    NULL text and NULL role count as empty; rows of NULL conv_id are one conversation. Equal turn numbers are
    ordered by role, then text; NULL turns come first; repeated rows are turns of their own. Other columns are
    ignored. An empty table gives no rows. An example holds its whole context by definition, so a conversation is
    put together in one row; conversations are spread over tasks by id.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(SEP))
    said = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.concat(head, escape(text), F.lit(CLOSE)).alias("piece"),
            F.length(head).alias("n_head"),
        ).alias("said"),
    )
    convs = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    n = F.size("turns")
    last = F.element_at("turns", -1)["role"] == "assistant"
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n))
    rows = convs.select("conv_id", "turns", last.alias("closed"), F.posexplode(ends).alias("example", "n_turns"))
    reply = F.element_at("turns", F.col("n_turns"))
    trainable = reply["role"] == "assistant"
    end = F.length("formatted") - F.lit(len(CLOSE))
    return (
        rows.select(
            "conv_id",
            F.col("example").cast("long").alias("example"),
            F.col("n_turns").cast("long").alias("n_turns"),
            F.array_join(F.transform(F.slice("turns", 1, F.col("n_turns")), lambda t: t["piece"]), "").alias("formatted"),
            (F.length(reply["piece"]) - reply["n_head"]).alias("n_reply"),
            trainable.alias("trainable"),
        )
        .select(
            "conv_id",
            "example",
            "n_turns",
            "formatted",
            F.when(F.col("trainable"), F.length("formatted") - F.col("n_reply")).otherwise(end).cast("long").alias("loss_start"),
            end.cast("long").alias("loss_end"),
            "trainable",
        )
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted text as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, F.length(p)), SEP, 1)).alias("role"),
            unescape(F.substring_index(p, SEP, -1)).alias("text"),
        ),
    )


def masked_text(formatted: Column, start: Column, end: Column) -> Column:
    """Trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, start + F.lit(1), end - start))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: counts and digests of turns and of trainable text."""
    last = F.max_by("formatted", "example")
    loss = F.array_sort(F.collect_list(F.when(F.col("trainable"), F.struct("example", masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")))))
    out = examples.groupBy("conv_id").agg(
        last.alias("whole"), loss.alias("loss"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"), F.count("*").alias("n_examples")
    )
    out = out.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"), "formatted_chars", "n_examples")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
