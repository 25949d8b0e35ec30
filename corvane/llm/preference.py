"""Preference formatting: a chosen and a rejected conversation share their longest common prefix of turns, which is
rendered once as the prompt; what follows in each becomes a completion with the spans that a loss may see.

Everything is a Spark SQL expression over two arrays of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, let

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def turns_of(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): the turns of each conversation in order; null texts count as empty and null roles as user. Turns of
    one number are ordered by role and text; each row without a key is a conversation of its own. Other columns are not read. An
    empty table has no conversation. A conversation is one record, so its turns must fit into a row."""
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    keyed = rows.select(F.col(key).alias("k"), own.alias("own"), F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))
    turn = F.struct("o", F.coalesce("r", F.lit("user")).alias("role"), F.coalesce("t", F.lit("")).alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return keyed.groupBy("k", "own").agg(ordered.alias("turns")).select(F.col("k").alias(key), "turns")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns at the start that are alike in role and text."""
    alike = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    unlike = F.array_position(alike, F.lit(False)).cast("int")
    return F.when(unlike > 0, unlike - 1).otherwise(F.least(F.size(chosen), F.size(rejected)))


def head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(f"{END}\n"))), "")


def mask(turns: Column) -> Column:
    """Spans (start, end) in code points of the rendered turns that an assistant wrote, each with its end mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        first = state["at"] + F.length(head(turn)).cast("long")
        last = first + F.length(turn["text"]).cast("long") + len(END)
        own = F.array(F.struct(first.alias("start"), last.alias("end")))
        spans = F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct((last + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", result: str = "preference") -> DataFrame:
    """pairs with a struct column `result`: n_common, prompt, chosen and rejected completions and their masks (spans in
    code points of the completion); an input column of that name is replaced. chosen and rejected are arrays of
    struct(role, text). A null array counts as empty. Where both are alike, or one begins the other, the completion that
    has nothing more is empty and has no span. Repeated rows give repeated rows, and an empty table an empty table."""
    c, r = fresh(pairs, "chosen"), fresh(pairs, "rejected")
    none = F.array().cast(TURNS)
    clean = lambda name: F.transform(F.coalesce(F.col(name).cast(TURNS), none), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rest = lambda turns, n: F.slice(turns, n + 1, F.size(turns))

    def built(n: Column) -> Column:
        parts = [n.cast("long").alias("n_common"), rendered(F.slice(F.col(c), F.lit(1), n)).alias("prompt")]
        for name, turns in (("chosen", F.col(c)), ("rejected", F.col(r))):
            after = rest(turns, n)
            parts += [rendered(after).alias(name), mask(after).alias(f"{name}_mask")]
        return F.struct(*parts)

    out = pairs.withColumns({c: clean(chosen), r: clean(rejected)})
    return out.withColumn(result, let(common_turns(F.col(c), F.col(r)), built)).drop(c, r)


def with_rejected(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """Pairs from conversations alone: chosen is a conversation; rejected has, in place of its last assistant turn and
    all after it, the assistant turn before that (an empty one if there is none). Conversations without an assistant
    turn are rejected as they are."""
    t = F.col(turns)
    own = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: F.get(t, i - 1)["role"] == ASSISTANT)
    instead = lambda at: F.struct(F.lit(ASSISTANT).alias("role"), F.coalesce(F.get(t, F.get(at, F.size(at) - 2) - 1)["text"], F.lit("")).alias("text"))
    rejected = let(own, lambda at: F.when(F.size(at) == 0, t).otherwise(F.concat(F.slice(t, F.lit(1), F.get(at, F.size(at) - 1) - 1), F.array(instead(at)))))
    return conversations.withColumns({"chosen": t, "rejected": rejected})
