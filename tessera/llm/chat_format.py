"""Chat formatting after cumulative-snapshot collapse.

A chat service logs a conversation again after every turn, so most logged
conversations are prefixes of longer ones. A rolling hash over the turns names
every prefix of every conversation. A conversation whose whole-length name is
the name of a proper prefix elsewhere is dropped by an anti join; of identical
conversations the smallest id stays. What is left is rendered.

The hash of a prefix is the xor of two independent 64-bit hashes of its
(position, role, text) triples, a running window aggregate, so that no turn list
is gathered for the comparison. Names are made distinct before they are joined;
a first turn that a third of all conversations share is one row there.

Cases: turns are ordered by turn number (null last), then role and text, and
positions are counted from that order, so gaps and repeated rows are defined; a
row repeated exactly counts as one turn. Null roles and texts are hashed as
such and rendered as empty; a null conversation id is a conversation of its own.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_names(conversations: DataFrame) -> DataFrame:
    """conv_id, position, n_turns, role, text and the names h1, h2 of the prefix that ends here."""
    turns = conversations.select("conv_id", "turn", "role", "text").dropDuplicates()
    by_conv = Window.partitionBy("conv_id")
    ordered = by_conv.orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = turns.withColumn("position", F.row_number().over(ordered))
    part = (F.col("position"), F.col("role").isNull(), F.col("text").isNull(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    running = by_conv.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.select(
        "conv_id", "position", "role", "text",
        F.bit_xor(F.xxhash64(*part)).over(running).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), *part)).over(running).alias("h2"),
        F.count(F.lit(1)).over(by_conv).alias("n_turns"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that prefix no longer one, one of each identical set."""
    named = prefix_names(conversations)
    whole = (
        named.filter("position = n_turns")
        .groupBy("h1", "h2", F.col("n_turns"))
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    )
    inner = named.filter("position < n_turns").select("h1", "h2", "position").distinct()
    longer = (whole.h1 == inner.h1) & (whole.h2 == inner.h2) & (whole.n_turns == inner.position)
    return whole.join(inner, longer, "left_anti").select("conv_id", "n_turns", "n_logged")


def render_chats(
    conversations: DataFrame, opening: str = "<|{role}|>\n", closing: str = "\n<|end|>\n", default_role: str = "user"
) -> DataFrame:
    """conv_id, n_turns, n_logged and the rendered chat of every maximal conversation.

    ``opening`` may hold ``{role}``. ``n_logged`` counts the identical logs.
    """
    before, _, after = opening.partition("{role}")
    named = prefix_names(conversations)
    role = F.coalesce("role", F.lit(default_role))
    said = F.concat(F.lit(before), role, F.lit(after), F.coalesce("text", F.lit("")), F.lit(closing))
    chats = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", said.alias("said")))).alias("turns"))
    kept = maximal_conversations(conversations).withColumnRenamed("conv_id", "_id")
    return chats.join(kept, chats["conv_id"].eqNullSafe(kept["_id"])).select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_logged", F.concat_ws("", F.col("turns.said")).alias("chat")
    )
