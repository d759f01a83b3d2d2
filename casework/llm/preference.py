"""Preference formatting: one prompt, two masked completions.

A pair is two conversations in turns. The longest run of equal turns at the start
of both is their prompt and is rendered once; what follows in the chosen and in the
rejected conversation are the completions. Each rendered turn tells which of its
characters a trainer may learn from: the words and the end mark of assistant turns in
completions, nothing elsewhere.

The work goes turn by turn and never gathers a conversation: turns are summed
up by two hashes each, the first turn that differs is a minimum per pair, and both are
summed before the shuffle; joins with a hot pair can be split. Rows come out one per rendered
turn, ordered by (pair_id, part, turn); :func:`assembled` joins them to
texts, where each example must fit in a row.

A null role or text renders as empty, a null turn counts as -1, and a null pair id is a pair
of its own. Repeated rows are one; several different rows of one turn are
compared as a set and rendered in the order of role and text. A conversation that is missing or
a prefix of the other has no completion. An empty table gives an empty result. Only the named
columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import written

# Fixed marks of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def turns(table: DataFrame, pair_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, turn, role, text; repeated rows once."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return table.select(F.col(pair_col).alias("pair_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
                        none(role_col).alias("role"), none(text_col).alias("text")).distinct()


def plain(text: Column) -> Column:
    """Text whose own marks cannot be taken for those of the rendered form."""
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def _summed(rows: DataFrame, side: str) -> DataFrame:
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "role", "text")) for k in range(2)]
    return rows.groupBy("pair_id", "turn").agg(F.struct(F.count("*"), *marks).alias(side))


def first_difference(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id and its first turn that is not in both alike (null: none is)."""
    one = _summed(chosen, "one").select(F.col("pair_id").alias("p"), F.col("turn").alias("t"), "one")
    both = one.join(_summed(rejected, "two"), F.col("p").eqNullSafe(F.col("pair_id")) & (F.col("t") == F.col("turn")), "full")
    pair = F.when(F.col("two").isNull(), F.col("p")).otherwise(F.col("pair_id")).alias("pair_id")
    differs = F.when(~F.col("one").eqNullSafe(F.col("two")), F.coalesce("t", "turn"))
    return both.groupBy(pair).agg(F.min(differs).alias("first"))


def formatted(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), turn, rendered, train_from,
    train_to (characters of ``rendered``; 0 and 0: none) of each turn.

    ``chosen`` and ``rejected`` are results of :func:`turns`.
    """
    first = first_difference(chosen, rejected).withColumnRenamed("pair_id", "p")
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))

    def side(rows: DataFrame, part: str) -> DataFrame:
        joined = rows.join(first, F.col("p").eqNullSafe(F.col("pair_id")))
        name = F.when(shared, "prompt").otherwise(part)
        return (joined if part == "chosen" else joined.where(~shared)).select("pair_id", name.alias("part"), "turn", "role", "text")

    rows = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    head = F.concat(F.lit(START), plain(F.col("role")), F.lit("\n"))
    body = F.concat(plain(F.col("text")), F.lit(END))
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    begin = F.length(head)
    return rows.select("pair_id", "part", "turn", F.concat(head, body, F.lit("\n")).alias("rendered"),
                       F.when(learned, begin).otherwise(0).cast("long").alias("train_from"),
                       F.when(learned, begin + F.length(body)).otherwise(0).cast("long").alias("train_to"))


def assembled(rows: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected as texts, with the spans to learn from
    in the two completions. A pair's text must fit in a row."""
    part = lambda p: F.sort_array(F.collect_list(F.when(F.col("part") == p, F.struct("turn", "rendered", "train_from", "train_to"))))
    text = lambda p: F.array_join(F.transform(p, lambda t: t["rendered"]), "")
    names = ("prompt", "chosen", "rejected")
    out = rows.groupBy("pair_id").agg(*[part(p).alias(p) for p in names])

    def spans(p: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<a: long, b: long>>)").alias("out"))

        def step(a: Column, t: Column) -> Column:
            span = F.struct((a["at"] + t["train_from"]).alias("a"), (a["at"] + t["train_to"]).alias("b"))
            return F.struct((a["at"] + F.length(t["rendered"])).alias("at"),
                            F.when(t["train_to"] > 0, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        return F.aggregate(F.col(p), start, step, lambda a: a["out"])

    return out.select("pair_id", *[text(F.col(p)).alias(p) for p in names], spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"))


def exchanged_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: a conversation is chosen; the same with
    the last answer of its neighbour (conv_id with the last bit turned) in place of its own last answer,
    and nothing after it, is rejected."""
    # Both sides are read several times below and in formatted().
    chosen = written(turns(conversations, "conv_id"), "chosen-turns")
    answer = F.max(F.when(F.col("role") == "assistant", F.col("turn")))
    ends = chosen.groupBy("pair_id").agg(answer.alias("answer"), F.max("turn").alias("end"))
    ends = ends.select(F.col("pair_id").alias("p"), "answer", F.coalesce("answer", F.col("end") + 1).alias("at"))
    own = chosen.join(ends, F.col("p").eqNullSafe(F.col("pair_id"))).drop("p")
    before = own.where("turn < at").select(*chosen.columns)
    answers = own.where("turn = answer and role = 'assistant' and pair_id is not null")
    answers = answers.select(F.expr("pair_id ^ 1").alias("pair_id"), "role", "text").join(ends.select(F.col("p").alias("pair_id"), "at"), "pair_id")
    rejected = before.unionByName(answers.select("pair_id", F.col("at").alias("turn"), "role", "text"))
    return chosen, written(rejected, "rejected-turns")
