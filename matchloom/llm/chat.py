"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged into a block by array
functions, and blocks are concatenated: ``<s>role`` and a line break, the texts with ``<t>`` between them, ``</s>``. In
roles and texts ``&``, ``<`` and ``[`` are written as entities, so no control string can occur in them, and reading back
is a split at the markers. The loss mask is an array of [start, end) spans in code points, one for each assistant turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What is escaped, in this order, and as what.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
LEARNED = "assistant"


def escape(c: Column) -> Column:
    for raw, entity in ENTITIES:
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&nl;"), F.lit("\n")))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, end) for each conv_id of ``rows`` (conv_id, turn, role, text).

    Null roles and texts are empty. Turns go by turn (null first), then role and text, so that repeated rows, each of which
    is a turn, have one order; a null conv_id is a conversation too. No rows give no rows; other columns are not read. A
    turn's place is a running sum over the sorted turns, so a conversation costs its length times the sort; its text is one
    value, so it must stay below Spark's 2 GB.
    """
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("name", _escape_role(F.col("role"))).withColumn("body", escape(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    last = F.lag("role").over(order)
    opens = last.isNull() | (last != F.col("role"))
    # Of "<s>", the name and a line break, after "</s>" if this isn't the first block; of "<t>" within a block.
    before = F.when(last.isNull(), F.length("name") + 4).when(opens, F.length("name") + 8).otherwise(3).cast("long")
    own = F.length("body").cast("long")
    placed = said.select("conv_id", "role", "name", "body", opens.alias("opens"), (before + own).alias("size"), "turn", "text")
    placed = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    turn = F.struct("end", (F.col("end") - own).alias("start"), "opens", (F.col("role") == LEARNED).alias("learned"), "name", "body")
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).withColumn("n", F.size("turns"))
    turns = turns.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("turns", i)["opens"]))
    block = lambda s, k: F.concat(
        F.lit("<s>"), F.get("turns", s)["name"], F.lit("\n"), F.array_join(F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.col("n")) - s), lambda t: t["body"]), "<t>"), F.lit("</s>")
    )
    learned = F.filter("turns", lambda t: t["learned"])
    spans = F.transform(learned, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return turns.select("conv_id", F.array_join(F.transform("starts", block), "").alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss (array of text): the inverse of ``format_chats``.

    The text under the loss mask is read from ``formatted`` at the spans' places. No rows give no rows; a null conv_id and
    other columns stay; repeated rows are read each time.
    """
    blocks = F.transform(F.filter(F.split("formatted", "</s>"), lambda b: b != ""), lambda b: F.substring(b, F.lit(4), F.length(b)))
    opened = F.transform(blocks, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("name"), F.split(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b)), "<t>").alias("texts")))
    turns = F.flatten(F.transform(opened, lambda b: F.transform(b["texts"], lambda t: F.struct(_unescape_role(b["name"]).alias("role"), t.alias("text")))))
    out = formatted.withColumn("raw", turns)
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return out.select("*", F.transform("raw", lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text"))).alias("turns"), loss.alias("loss")).drop("raw")


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, from what is read back: one row for each row of ``formatted``."""
    back = parse_chats(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
