"""Preference formatting: one prompt and two masked completions from a pair of conversations.

Chosen and rejected turns are put in order and compared from the front; the turns they share are rendered
once, as the prompt. What follows on each side is rendered as that side's completion, with the spans that
a trainer may learn from: what an assistant says there, with its end mark. The rest is masked.

Cases: null text and null role are empty; turns tie by role and text; repeated turns stay; a side without
turns, or equal to the other, gives an empty completion without spans; a null pair is a pair of its own.
Turns without a conversation (null key) are one conversation. A conversation is one row, as a document is
one, however long its texts. An empty table gives no rows. Extra columns of pairs stay; one that is named
like a column of the result is replaced by it. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: array of (role, text) in order."""
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(row))
    return turns.groupBy(F.col(key).alias("key")).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def learnt(turns: Column) -> Column:
    """[from, to) spans of characters of the rendered turns that the loss counts."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head = state["at"] + F.length(turn["role"]) + len(OPEN) + len(CLOSE)
        to = head + F.length(turn["text"]) + len(END)
        span = F.struct(head.cast("int").alias("from"), to.cast("int").alias("to"))
        return F.struct(to.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def preference_rows(pairs: DataFrame) -> DataFrame:
    """pairs: any columns, with chosen and rejected arrays of (role, text) (null: no turns). Adds n_prompt_turns, prompt, and for each side its completion and spans."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.withColumn("chosen", F.coalesce("chosen", none)).withColumn("rejected", F.coalesce("rejected", none))
    cut = sides.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0))) for c in ("chosen", "rejected")}
    return cut.withColumns(
        {"prompt": render(F.slice("chosen", 1, F.col("n_prompt_turns")))} | {f"{c}_text": render(r) for c, r in rest.items()} | {f"{c}_spans": learnt(r) for c, r in rest.items()}
    ).drop("chosen", "rejected")


def swapped_answers(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs from plain conversations: the rejected side of 2i and 2i + 1 has each other's last assistant turn in place of its own.

    A conversation without a partner, or a partner without an answer, is rejected without that turn."""
    full = conversations(turns, key)
    spots = F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))
    full = full.withColumn("at", F.coalesce(F.array_max(spots), F.lit(0))).withColumn("answer", F.when(F.col("at") > 0, F.element_at("turns", F.greatest("at", F.lit(1)).cast("int"))))
    other = full.select(F.col("key").bitwiseXOR(F.lit(1)).alias("key"), F.col("key").alias("partner"), F.col("answer").alias("other"))
    joined = full.join(other, "key", "left")
    swap = F.concat(F.slice("turns", 1, F.greatest(F.col("at") - 1, F.lit(0)).cast("int")), F.when(F.col("other").isNotNull(), F.array("other")).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    return joined.select(F.col("key").alias(key), "partner", F.col("turns").alias("chosen"), F.when(F.col("at") > 0, swap).otherwise(F.col("turns")).alias("rejected"))
