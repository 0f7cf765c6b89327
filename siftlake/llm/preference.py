"""Preference formatting of conversations.

Two conversations make a pair, chosen and rejected.  The longest prefix of turns
that both share (role and text) is rendered once, as the prompt; what follows in
each is its completion, with the character ranges that a loss may see: those of
the assistant's texts with their end marks.  All in SQL expressions; a pair's
turns meet once, by the pair's key, and are part of its row in any case.

A null role or text is an empty one; rows of the same turn follow each other by
role and text, repeated rows stay.  A conversation without a partner is its
pair's chosen or rejected side, with an empty prompt and null for the other.  A
turn without a pair is a conversation by itself, with a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURN = "concat('<|', t.role, '|>\\n', t.text, '<|end|>\\n')"


def format_pairs(turns: DataFrame, pair: Column, rejected: Column, turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant") -> DataFrame:
    """(pair, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask); a mask is a list of [first, last) ranges."""
    rows = turns.select(pair.alias("pair"), F.coalesce(rejected, F.lit(False)).alias("bad"), F.struct(turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text")).alias("t"))
    some = rows.where("pair is not null").groupBy("pair").agg(F.sort_array(F.collect_list(F.when(~F.col("bad"), F.col("t")))).alias("c"), F.sort_array(F.collect_list(F.when(F.col("bad"), F.col("t")))).alias("r"))
    none = F.expr("filter(array(t), t -> false)")
    lone = rows.where("pair is null").select("pair", F.when(F.col("bad"), none).otherwise(F.array("t")).alias("c"), F.when(F.col("bad"), F.array("t")).otherwise(none).alias("r"))
    both = some.unionByName(lone)
    prefix = "if(least(size(c), size(r)) = 0, 0, aggregate(sequence(0, greatest(least(size(c), size(r)), 1) - 1), 0, (n, i) -> if(n = i and c[i].role = r[i].role and c[i].text = r[i].text, n + 1, n)))"
    both = both.withColumn("n", F.expr(prefix))
    mask = "aggregate({0}, named_struct('at', 0, 'm', cast(array() as array<array<int>>)), (a, t) -> named_struct('at', a.at + char_length(t.role) + char_length(t.text) + 13, 'm', if(t.role = '{1}', concat(a.m, array(array(a.at + char_length(t.role) + 5, a.at + char_length(t.role) + 12 + char_length(t.text)))), a.m))).m"
    joined = "array_join(transform({0}, t -> " + _TURN + "), '')"
    out = both.select("pair", F.col("n").cast("long").alias("n_prompt_turns"), F.expr(joined.format("slice(c, 1, n)")).alias("prompt"), *[F.expr(f"if(size({x}) = 0, null, {e.format(f'slice({x}, n + 1, size({x}))', learner)})").alias(name) for x, name, e in (("c", "chosen", joined), ("r", "rejected", joined), ("c", "chosen_mask", mask), ("r", "rejected_mask", mask))])
    return out


def halves(conversation: Column) -> tuple[Column, Column]:
    """(pair, rejected) where conversations 2k and 2k + 1 are a pair, for all whole numbers of 64 bits."""
    number = conversation.cast("long")
    return F.shiftright(number, 1), number.bitwiseAND(F.lit(1).cast("long")) == 1


def printed(mask: str) -> Column:
    return F.expr(f"array_join(transform({mask}, x -> concat(x[0], '-', x[1])), ',')")
