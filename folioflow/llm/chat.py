"""Chat formatting with Spark expressions: turns in order, same-role neighbours merged, a loss mask, and back.

The template is `<turn>role</role>text</turn>` and a line break; texts of adjacent turns of one role share
a turn, divided by `</part>`. Inside roles and texts every backslash is doubled and a backslash parts the
`<` of a control string from its rest, so no control string is left in a text and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, ROLE, PART, END = "<turn>", "</role>", "</part>", "</turn>"
#: Code points of a part of a formatted conversation, when it is read back.
PIECE = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(?=turn>|/role>|/part>|/turn>)", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the text of each conversation and its loss mask.

    loss: array of (start, length) in code points of formatted, one for each text of loss_role; together
    they cover those texts, escaped, and nothing between. Turns are ordered by turn, then role, then text
    (ties and repeated rows all stay). Nulls: a null text or role is empty, a null turn comes first, rows
    of a null conv_id are a conversation of their own. An empty table gives an empty result. Columns beside
    conv_id, turn, role and text are not read. A conversation is one value in the end, so its rows meet in
    one task by nature. Places are running sums over the turns, so the work is linear in turns (but for
    sorting them) and in characters.
    """
    # a row's text is escaped and measured before the shuffle, where long conversations are still spread over tasks
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", escape(F.col("text")).alias("body")).withColumn("size", F.length("body").cast("bigint"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    opens = ~F.lag("role").over(order).eqNullSafe(F.col("role"))
    closes = ~F.lead("role").over(order).eqNullSafe(F.col("role"))
    head = F.when(opens, F.concat(F.lit(TURN), escape(F.col("role")), F.lit(ROLE))).otherwise(F.lit(PART))
    tail = F.when(closes, F.lit(END + "\n")).otherwise(F.lit(""))
    rows = rows.withColumns({"head": head, "tail": tail, "place": F.row_number().over(order)})
    whole = F.length("head") + F.col("size") + F.length("tail")
    until = F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("start", until - F.length("tail") - F.col("size"))
    span = F.when(F.col("role") == loss_role, F.struct("start", F.col("size").alias("length")))
    pieces = F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body", "tail").alias("x"), span.alias("span"))))
    return rows.groupBy("conv_id").agg(pieces.alias("ps")).select(
        "conv_id", F.array_join(F.transform("ps", lambda p: p["x"]), "").alias("formatted"), F.array_compact(F.transform("ps", lambda p: p["span"])).alias("loss")
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) from (conv_id, formatted, loss).

    turns: array of (role, text), merged turns told apart again; loss_text: what the mask covers, unescaped. The work is
    linear in characters.
    """
    blocks = F.filter(F.split("formatted", END + "\n"), lambda b: F.length(b) > 0)

    def turns_of(block: Column) -> Column:
        at = F.instr(block, ROLE)
        role = unescape(F.substr(block, F.lit(len(TURN) + 1), at - len(TURN) - 1))
        texts = F.split(F.substr(block, at + len(ROLE)), PART)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    # the text under a span is cut from the parts of equal length that hold it, not counted from the text's beginning;
    # the outer array binds the parts to a name, so they are made once a row
    def under(whole: Column) -> Column:
        def cut(span: Column) -> Column:
            first, last = F.floor(span["start"] / PIECE), F.floor((span["start"] + span["length"]) / PIECE)
            near = F.array_join(F.slice(whole["parts"], (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            return unescape(F.substr(near, (span["start"] - first * PIECE + 1).cast("int"), span["length"].cast("int")))

        return F.transform(whole["loss"], cut)

    parts = F.regexp_extract_all("formatted", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    covered = F.flatten(F.transform(F.array(F.struct(parts.alias("parts"), F.col("loss").alias("loss"))), under))
    return formatted.select(
        "conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(covered, "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
