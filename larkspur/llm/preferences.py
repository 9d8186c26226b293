"""Preference formatting: a shared prompt and paired, masked completions.

Of a chosen and a rejected conversation, the longest common prefix of turns
(equal role and text) is rendered once as the prompt. What follows on either
side is its completion. The mask of a completion is the list of character spans,
counted from the prompt's start, in which tokens count in the loss: the texts of
assistant turns with their end marker.

Both sides are gathered in one aggregation on the pair, so each turn moves once.
A pair's turns are one row, as the rendered result is. Everything is DataFrame
expressions.

Edge cases: turns are ordered by turn, role and text, null turns first. A null
role is a user's, a null text empty. A turn without a pair id is a pair of its own,
whose other side is empty. A side without
turns gives an empty prompt and completion on that side; equal sides give two
empty completions. Repeated rows are repeated turns. An empty table gives an
empty result. Extra columns are not read. The marker's opening in a text is
broken up by a space, so a text can't forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_BROADCAST_ROWS = 1_000_000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _turn(t["role"], t["text"])), "")


def _spans(turns: Column, start: Column) -> Column:
    """Character spans of the assistant's texts and end markers."""
    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(_turn(t["role"], t["text"]))
        span = F.struct((acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit("\n")))).alias("start"), end.alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: pair id, common_turns, prompt, chosen, rejected, chosen_spans, rejected_spans."""

    def side(df: DataFrame, name: str) -> DataFrame:
        text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
        role = F.replace(F.coalesce(F.col(role_col), F.lit("user")), F.lit("<|im_"), F.lit("< |im_"))
        turn = F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        return df.select(F.col(pair_col).alias("pair"), F.lit(name).alias("side"), turn.alias("said"))

    both = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("said"))))
    both = both.withColumn("lone", F.when(F.col("pair").isNull(), F.monotonically_increasing_id()))
    pairs = both.groupBy("pair", "lone").agg(of("chosen").alias("c"), of("rejected").alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    differs = lambda i: (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"])
    pairs = pairs.withColumn("n", F.coalesce(F.get(F.filter(places, differs), F.lit(0)), shorter))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.size(x))
    pairs = pairs.select("pair", "n", _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), F.when(F.size("c") > 0, rest("c")).otherwise(F.col("c")).alias("c"), F.when(F.size("r") > 0, rest("r")).otherwise(F.col("r")).alias("r"))
    start = F.length("prompt")
    return pairs.select(F.col("pair").alias(pair_col), F.col("n").cast("long").alias("common_turns"), "prompt", _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _spans(F.col("c"), start).alias("chosen_spans"), _spans(F.col("r"), start).alias("rejected_spans"))


def swapped_answers(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations, with a pair_id.

    Chosen is a conversation; in the rejected one its last assistant turn has the
    text of the last assistant turn of the conversation numbered one higher, or is
    missing if there is none. All other turns, those after that answer included, are
    on both sides. Conversations without an assistant turn are equal on both sides;
    a turn without a conversation is on the chosen side alone. Repeated last answers
    count as one on the rejected side; turns without a number come first and are
    never swapped.
    """
    rows = turns.select(F.col(conv_col).alias("pair_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    answers, others = rows.where("role = 'assistant' AND pair_id IS NOT NULL"), rows.where("NOT coalesce(role = 'assistant', false) AND pair_id IS NOT NULL")
    final = answers.groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("final")).where("final.turn IS NOT NULL")
    final = Scratch(turns.sparkSession, "answers").table(final.select("pair_id", F.col("final.turn").alias("last"), F.col("final.text").alias("other")), "final")
    last = final.select("pair_id", "last")
    few = F.broadcast(last) if last.count() <= MAX_BROADCAST_ROWS else last  # 16 bytes each; answers then stay where they are
    stays = others.unionByName(answers.join(few, "pair_id", "left").where("NOT coalesce(turn = last, false)").select(*rows.columns))
    shifted = final.select((F.col("pair_id") - 1).alias("pair_id"), "other")
    swapped = last.join(shifted, "pair_id").select("pair_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    return rows, stays.unionByName(swapped)
