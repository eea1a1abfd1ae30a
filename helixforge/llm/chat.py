"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply lies under the
loss mask.  The template is

    <|im_start|>role\\ntext<|im_end|>\\n

Backslashes in texts and roles are doubled and "<|" becomes "<\\|", so no text can close or open a turn, and
``unescape`` gives the very text back (an odd backslash after "<" can only come from escaping).

Defined results: a null role or text is empty; turns come in the order of (turn, role, text), nulls first, and repeated
rows are turns of their own; rows without conv_id form one conversation with a null id; a conversation that does not end
with an assistant turn ends with one example without a target (null loss bounds), so that no turn is lost; no rows give
no rows; further columns are ignored.  The size of the output is quadratic in the turns of one conversation: that is
the method.  What one task must hold is one conversation, and its turns are rendered once and shared by its examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, example (position of its last turn, from 0), formatted, loss_start, loss_end
    (code points, end exclusive, of the escaped reply in formatted)."""
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rendered = whole.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["role"].alias("role"),
                F.length(escape(t["text"])).alias("n"),
                F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE)).alias("s"),
            ),
        ).alias("turns"),
    )
    each = rendered.select("conv_id", "turns", F.posexplode("turns.role").alias("example", "role")).where(
        (F.col("role") == "assistant") | (F.col("example") == F.size("turns") - 1)
    )
    texts = each.select(
        "conv_id",
        "example",
        F.array_join(F.slice("turns.s", F.lit(1), F.col("example") + 1), "").alias("formatted"),
        F.when(F.col("role") == "assistant", F.element_at("turns.n", F.col("example") + 1)).alias("n"),
    )
    end = F.length("formatted") - len(CLOSE)
    return texts.select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("n").isNotNull(), end - F.col("n")).alias("loss_start"),
        F.when(F.col("n").isNotNull(), end).alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """formatted -> its turns, array<struct<role, text>>, unescaped."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        first = F.length(role) + 2
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substr(s, first, F.length(s) - first + 1 - len(CLOSE))).alias("text"),
        )

    return F.transform(parts, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, for the contract's digests."""
    loss = F.when(
        F.col("loss_start").isNotNull(),
        F.struct(
            F.col("example"),
            unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("s"),
        ),
    )
    by = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.sort_array(F.collect_list(loss)).alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turns = by.select("conv_id", parse(F.col("last")).alias("turns"), F.array_join("loss.s", "").alias("loss"), "formatted_chars")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
