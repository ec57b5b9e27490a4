"""Rows of conversations (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_roles(rows: DataFrame) -> DataFrame:
    """(conv_id, island, role, n, text): neighbouring messages of one role as one, texts joined by line
    ends in order of turn; null is a role of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    starts = F.row_number().over(order).eqNullSafe(F.lit(1)) | ~F.lag("role").over(order).eqNullSafe(F.col("role"))
    held = rows.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return held.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("n"), joined.alias("text"))


def provider_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, first_turn, role, blocks) of rows (conv_id, turn, role, content, tool_calls, tool_call_id): what a
    provider with tools takes.

    Blocks are (kind, id, name, body): text, tool_use or tool_result.  Neighbouring tool rows are one
    turn of the user; system rows are apart and end such a run; an assistant's turn without text and
    calls goes.  ``tool_calls`` are (id, name, arguments).
    """
    kind = "struct<kind:string,id:string,name:string,body:string>"
    block = lambda k, i, n, b: F.struct(F.lit(k).alias("kind"), i.cast("string").alias("id"), n.cast("string").alias("name"), b.alias("body"))
    none, said = F.lit(None), F.coalesce("content", F.lit(""))
    called = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: block("tool_use", c["id"], c["name"], c["arguments"]))
    spoken = F.when(said != "", F.array(block("text", none, none, said))).otherwise(F.array().cast(f"array<{kind}>"))
    blocks = F.when(F.col("role") == "assistant", F.concat(spoken, called)).when(F.col("role") == "tool", F.array(block("tool_result", F.col("tool_call_id"), none, said))).otherwise(F.array(block("text", none, none, said)))
    order = Window.partitionBy("conv_id").orderBy("turn")
    alone = (F.col("role") != "tool") | ~F.lag("role").over(order).eqNullSafe(F.lit("tool"))
    held = rows.filter(F.col("role").isin("system", "user", "assistant", "tool")).select("conv_id", "turn", "role", blocks.alias("blocks"), alone.cast("int").alias("alone"))
    runs = held.withColumn("island", F.sum("alone").over(order)).groupBy("conv_id", "island")
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "blocks"))), lambda x: x["blocks"]))
    out = runs.agg(F.min("turn").alias("first_turn"), F.min("role").alias("role"), listed.alias("blocks"))
    return out.select("conv_id", "first_turn", F.when(F.col("role") == "tool", "user").otherwise(F.col("role")).alias("role"), "blocks").filter(F.size("blocks") > 0)


def plain_turns(rows: DataFrame, longest: int = 4000) -> DataFrame:
    """(conv_id, island, role, n, text): the same without tools.  Calls and results are told in words, results cut
    at ``longest`` characters, and neighbours of one role merged."""
    said = F.coalesce("content", F.lit(""))
    calls = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: F.concat(F.lit("[Called tool "), c["name"], F.lit("("), c["arguments"], F.lit(")]")))
    told = F.array_join(F.concat(F.when(said != "", F.array(said)).otherwise(F.array().cast("array<string>")), calls), "\n")
    result = F.concat(F.lit("[Tool "), F.coalesce("name", "tool_call_id", F.lit("")), F.lit(" result]: "), F.substring(said, 1, longest))
    role = F.when(F.col("role") == "tool", "user").otherwise(F.col("role"))
    text = F.when(F.col("role") == "assistant", told).when(F.col("role") == "tool", result).otherwise(said)
    held = rows.filter(F.col("role").isin("user", "assistant", "tool")).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return merge_roles(held.filter((F.col("role") != "assistant") | (F.col("text") != "")))


def exchanges(rows: DataFrame, apart: int = 60, left_out: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, turn, from_column, to_column, y): each message to the role that speaks next, as an arrow
    of a sequence diagram.  Columns are the roles in order, a few in all; a message from or to a role
    that is left out has no arrow but keeps its place."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    m = rows.select("conv_id", "turn", F.col("role").alias("sender"), F.lead("role").over(order).alias("receiver"), (F.row_number().over(order) - 1).cast("long").alias("slot"))
    roles = F.array_sort(F.collect_set(F.when(~F.col("role").isin(*left_out), F.col("role"))))
    actors = rows.agg(roles.alias("all")).select(F.posexplode("all").alias("at", "role")).select(F.col("at").cast("long"), "role")
    sender, receiver = (actors.select(F.col("role").alias(n), F.col("at").alias(c)) for n, c in (("sender", "from_column"), ("receiver", "to_column")))
    return m.join(sender, "sender").join(receiver, "receiver").select("conv_id", "turn", "from_column", "to_column", (F.col("slot") * apart).alias("y"))
