r"""Chat formatting with a grammar round trip; DataFrame functions only.

Grammar of a rendered conversation (fixed control strings)::

    conversation := "<s>" turn*
    turn         := "[INST] " text " [/INST]"            user
                  | " " text "</s>"                      assistant
                  | "[ROLE]" role "\n" text "[/ROLE]"    any other role
    escape       := "\" between the first two characters of a control string, and before a "\"

The parser cuts behind every end mark, reads the kind of a turn off its marks, and takes the escapes
out. A turn is rendered as it is; where the parser does not give back the same turn it is escaped,
and where the whole conversation still differs all its turns are. Escaped text holds no control
string, so the second form is final; the result is checked all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, USER, USER_END = "<s>", "[INST] ", " [/INST]"
REPLY, REPLY_END = " ", "</s>"
OTHER, OTHER_END = "[ROLE]", "[/ROLE]"
#: The first character of a control string.
CONTROL = r"([<\[])(?=s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\])"
CUT = r"(?<=\[/INST\])|(?<=</s>)|(?<=\[/ROLE\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\\)", r"\\\\"), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_marks(role: Column) -> tuple[Column, Column]:
    """Opening and closing mark of a (rendered) role."""
    start = F.when(role == "user", F.lit(USER)).when(role == "assistant", F.lit(REPLY))
    end = F.when(role == "user", F.lit(USER_END)).when(role == "assistant", F.lit(REPLY_END))
    other = F.concat(F.lit(OTHER), role, F.lit("\n"))
    return start.otherwise(other), end.otherwise(F.lit(OTHER_END))


def rendered_turn(turn: Column, escape: Column) -> Column:
    """A turn (struct of role, text) between its marks; the line ends of a role's name are escaped."""
    role = F.when(escape, F.regexp_replace(escaped(turn["role"]), "(\n)", r"\\n")).otherwise(turn["role"])
    start, end = turn_marks(role)
    return F.concat(start, F.when(escape, escaped(turn["text"])).otherwise(turn["text"]), end)


def parsed_turns(formatted: Column) -> Column:
    """Array of (role, text, start, length) read from rendered text; start and length of the raw text.

    ``start`` counts from the beginning of the piece; null pieces and pieces without marks give a null role.
    """
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    pieces = F.filter(F.split(body, CUT, -1), lambda p: p != "")

    def parse(p: Column) -> Column:
        size = F.length(p)
        head = F.position(F.lit("\n"), p)
        inner = lambda start, end: F.substring(p, start, size - (start - 1) - end)
        user = p.startswith(USER) & p.endswith(USER_END)
        reply = p.startswith(REPLY) & p.endswith(REPLY_END)
        other = p.startswith(OTHER) & p.endswith(OTHER_END) & (head > 0)
        role_at = len(OTHER) + 1
        role = F.substring(p, F.lit(role_at), head - role_at)
        role = unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
        return (
            F.when(user, piece(F.lit("user"), F.lit(len(USER) + 1), F.lit(len(USER_END)), inner, size))
            .when(reply, piece(F.lit("assistant"), F.lit(len(REPLY) + 1), F.lit(len(REPLY_END)), inner, size))
            .when(other, piece(role, head + 1, F.lit(len(OTHER_END)), inner, size))
            .otherwise(piece(F.lit(None).cast("string"), F.lit(1), F.lit(0), inner, size))
        )

    return F.transform(pieces, parse)


def piece(role: Column, start: Column, end: Column, inner, size: Column) -> Column:
    return F.struct(
        role.alias("role"),
        unescaped(inner(start, end)).alias("text"),
        (start - 1).alias("start"),
        (size - (start - 1) - end).alias("length"),
        size.alias("size"),
    )


def said(turns: Column) -> Column:
    """Roles and texts alone, to compare a parse with its source."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def formatted_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, ``mask`` and ``turns``, the parse of ``formatted``.

    ``turns`` needs conv_id, turn, role, text; others are not read. Rows are ordered by turn, ties by
    role, then text; repeated rows are turns of their own. A null text or role counts as empty; a
    null turn comes first; rows with a null conv_id form one conversation. ``mask`` holds (start,
    length) of each assistant's text in ``formatted``, in code points from 0. A table without rows gives none.
    """
    one = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    # A turn that does not come back alone is escaped.
    alone = F.concat(F.lit(BEGIN), rendered_turn(F.col("t"), F.lit(False)))
    source = F.array(F.struct(F.col("t.role").alias("role"), F.col("t.text").alias("text")))
    one = one.withColumn("conflict", ~said(parsed_turns(alone)).eqNullSafe(source))
    one = one.withColumn("plain", rendered_turn(F.col("t"), F.col("conflict")))
    one = one.withColumn("safe", rendered_turn(F.col("t"), F.lit(True)))
    chats = one.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("t.turn", "t.role", "t.text", "plain", "safe"))).alias("all")
    )
    whole = lambda form: F.concat(F.lit(BEGIN), F.array_join(F.transform("all", lambda t: t[form]), ""))
    chats = chats.select("conv_id", said(F.col("all")).alias("source"), whole("plain").alias("plain"), whole("safe").alias("safe"))
    # A conversation that does not come back whole is escaped throughout.
    same = said(parsed_turns(F.col("plain"))).eqNullSafe(F.col("source"))
    chats = chats.select("conv_id", "source", F.when(same, F.col("plain")).otherwise(F.col("safe")).alias("formatted"))
    chats = chats.withColumn("turns", parsed_turns(F.col("formatted")))
    lost = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    chats = chats.withColumn(
        "formatted", F.when(said(F.col("turns")).eqNullSafe(F.col("source")), F.col("formatted")).otherwise(lost)
    )
    first = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    walk = F.aggregate(
        "turns",
        first,
        lambda acc, t: F.struct(
            (acc["at"] + t["size"]).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(acc["mask"], F.array(F.struct((acc["at"] + t["start"]).alias("start"), t["length"].alias("length")))),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    return chats.select("conv_id", "formatted", walk["mask"].alias("mask"), said(F.col("turns")).alias("turns"))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"] + 1, m["length"]))), ""
    )
