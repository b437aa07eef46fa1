"""Preference examples from pairs of conversations: one prompt, two masked completions.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once, as the
prompt; what follows it is the chosen and the rejected completion. Training loss falls only on the turns of the assistant
in a completion. ``preference_turns`` has one row per rendered turn, ``assembled`` joins them to strings with the spans that are learnt,
one row per pair, or per 4,096 turn numbers of a long one, so that no conversation has to fit into one row or one task.

Defined results: rows with a null conversation or turn belong to no conversation and are left out; rows that repeat
(conversation, turn, role, text) count once; different rows of one turn number are taken in the order of role and text. A null
role or text is rendered as empty and equals only null. Equal conversations give a prompt and no completion. A pair
of which one side has no turns has an empty prompt. Empty tables give an empty result; other columns are not read.
Everything runs on DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNT_ROLE = "assistant"
BLOCK_TURNS = 4_096
SIDES = ("chosen", "rejected")


def rendered(role: Column, text: Column) -> Column:
    """One turn as text: a header with the role, the content, an end mark."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for a table without ratings: whole conversations whose ids differ in the lowest bit, the even one chosen.

    Every turn of every conversation is in exactly one pair; one without a neighbour is a pair with an empty side. Returns pair_id (the even id),
    side, turn, role, text.
    """
    return turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        F.col("conv_id").bitwiseAND(F.lit(-2).cast("long")).alias("pair_id"),
        F.when(F.col("conv_id").bitwiseAND(F.lit(1).cast("long")) == 0, SIDES[0]).otherwise(SIDES[1]).alias("side"), "turn", "role", "text")


def preference_turns(sides: DataFrame) -> DataFrame:
    """Split the turns of pairs into prompt and completions.

    ``sides`` has the columns pair_id, side ('chosen' or 'rejected'), turn, role, text. Returns pair_id, part
    ('prompt', 'chosen', 'rejected'), turn, sub, role, rendered, learnt; ``sub`` counts different rows of one turn.
    """
    # All that concerns one turn of a pair happens where its rows meet first: repeats go, rows are numbered, both sides of a place
    # come together. The first place at which they differ ends the prompt.
    rows = sides.where(F.col("pair_id").isNotNull()).select("pair_id", "side", "turn", "role", "text").repartition("pair_id", "turn").distinct()
    order = Window.partitionBy("pair_id", "turn", "side").orderBy("role", "text")
    rows = rows.withColumn("sub", F.row_number().over(order))

    def of(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.struct("role", "text")))

    places = rows.groupBy("pair_id", "turn", "sub").agg(*(of(side).alias(side) for side in SIDES))
    differs = ~(F.col("chosen").eqNullSafe(F.col("rejected")))
    first = places.groupBy("pair_id").agg(F.min(F.when(differs, F.struct("turn", "sub"))).alias("first"))
    parted = places.join(first, "pair_id").withColumn(
        "common", F.col("first").isNull() | (F.struct("turn", "sub") < F.col("first")))
    part = F.when(F.col("common"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(
        F.array(*(F.struct(F.lit(side).alias("part"), F.col(side).alias("said")) for side in SIDES)))
    return parted.select("pair_id", "turn", "sub", F.explode(part).alias("p")).where(F.col("p.said").isNotNull()).select(
        "pair_id", F.col("p.part").alias("part"), "turn", F.col("sub").cast("int").alias("sub"),
        F.col("p.said.role").alias("role"),
        rendered(F.col("p.said.role"), F.col("p.said.text")).alias("rendered"),
        F.coalesce((F.col("p.part") != "prompt") & (F.col("p.said.role") == LEARNT_ROLE), F.lit(False)).alias("learnt"))


def assembled(parts: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """pair_id, block, prompt, chosen, rejected as strings, and the learnt character spans of both completions.

    One row per pair, or one per ``block`` turn numbers of a longer one: the strings of its rows follow each other, and spans count
    within the row.
    """
    blocks = parts.withColumn("block", F.floor(F.col("turn") / block))

    def turns(part: str) -> Column:
        said = F.struct("turn", "sub", "rendered", "learnt")
        return F.array_sort(F.collect_list(F.when(F.col("part") == part, said)))

    rows = blocks.groupBy("pair_id", "block").agg(turns("prompt").alias("prompt"), *(turns(s).alias(s) for s in SIDES))

    def text(part: str) -> Column:
        return F.array_join(F.transform(part, lambda x: x["rendered"]), "")

    def spans(part: str) -> Column:
        # The running end of the turns, and a span for each learnt one.
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        return F.aggregate(part, start, lambda done, x: F.struct(
            (done["end"] + F.length(x["rendered"])).alias("end"),
            F.when(x["learnt"], F.concat(done["spans"], F.array(F.struct(done["end"].alias("start"), (done["end"] + F.length(x["rendered"])).alias("end")))))
            .otherwise(done["spans"]).alias("spans")))["spans"]

    return rows.select("pair_id", "block", text("prompt").alias("prompt"), *(text(s).alias(s) for s in SIDES),
                       *(spans(s).alias(f"{s}_learnt") for s in SIDES))


def spans_as_text(spans: Column) -> Column:
    """Spans as ``start-end`` with commas between them."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
