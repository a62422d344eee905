"""Preference pairs as one prompt and two masked completions.

The turns that a chosen and a rejected conversation share at their start are the prompt and are
rendered once; what follows in each is its completion. A completion carries a mask as spans of
characters: only assistant turns are trained on, with their end mark but without their header.

Turns are grouped per pair and chunk of turn numbers, so a very long conversation is compared and
rendered in many tasks; a last step strings its few chunks together. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURNS_PER_CHUNK = 256
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def _rendered(t: Column, head: Column) -> Column:
    return F.concat(head, F.coalesce(t["text"], F.lit("")), F.lit(END))


def _head(t: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"))


def _side(side: str) -> Column:
    turn = F.struct("turn", "role", "text")
    return F.array_sort(F.collect_list(F.when(F.col("side") == side, turn))).alias(side)


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _rendered(t, _head(t))), "")


def _masks(turns: Column) -> Column:
    """(first, last) character of every trained part and the length of all, from offset 0."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state["at"] + F.length(_head(t))
        last = state["at"] + F.length(_rendered(t, _head(t)))
        span = F.array(F.struct(first.alias("first"), last.alias("last")))
        trained = F.coalesce(t["role"] == TRAINED, F.lit(False))
        return F.struct(last.cast("long").alias("at"), F.when(trained, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)


def preferences(turns: DataFrame) -> DataFrame:
    """One row per pair: ``prompt``, ``chosen``, ``rejected``, their masks and numbers of turns.

    ``turns`` has ``pair_id``, ``side`` ('chosen' or 'rejected'), ``turn``, ``role``, ``text``. Turns go by
    number, turns of one number by role and text; two are the same if number, role and text are (nulls
    equal each other). A null role or text is rendered as an empty one. A pair with one side only has an
    empty prompt and one empty completion. If one conversation is the start of the other, its completion
    is empty. Rows with a null pair or another side are left out; an empty table gives an empty one.
    Masks are ``first:last`` character spans (end exclusive) in the completion, joined by commas.
    """
    rows = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).select(
        "pair_id", "side", F.col("turn").cast("long").alias("turn"), "role", "text",
        F.coalesce(F.floor(F.col("turn") / TURNS_PER_CHUNK), F.lit(-1)).alias("chunk"),
    )
    chunks = rows.groupBy("pair_id", "chunk").agg(_side("chosen"), _side("rejected"))
    least = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.filter(
        F.transform(F.arrays_zip("chosen", "rejected"), lambda p, i: F.struct((~p["chosen"].eqNullSafe(p["rejected"])).alias("d"), i.alias("i"))),
        lambda x: x["d"],
    )
    same = F.coalesce(F.get(differs, F.lit(0))["i"], least)
    chunks = chunks.select("pair_id", "chunk", "chosen", "rejected", same.alias("same"))
    broken = F.when((F.col("same") < F.size("chosen")) | (F.col("same") < F.size("rejected")), F.col("chunk"))
    # Chunks before the first broken one are all prompt, later ones all completion.
    ends = chunks.select("pair_id", "chunk", broken.alias("broken")).groupBy("pair_id").agg(F.min("broken").alias("end"))
    joined = chunks.join(ends, "pair_id")
    kept = F.when(F.col("end").isNull() | (F.col("chunk") < F.col("end")), F.size("chosen")).when(
        F.col("chunk") == F.col("end"), F.col("same")
    ).otherwise(F.lit(0))
    parts = joined.select(
        "pair_id", "chunk", kept.alias("kept"), F.slice("chosen", F.lit(1), kept).alias("p"),
        F.slice("chosen", kept + 1, F.size("chosen")).alias("c"), F.slice("rejected", kept + 1, F.size("rejected")).alias("r"),
    )
    parts = parts.select(
        "pair_id", F.struct(
            "chunk", "kept", _text(F.col("p")).alias("prompt"), F.size("c").alias("n_c"), F.size("r").alias("n_r"),
            _text(F.col("c")).alias("c"), _masks(F.col("c")).alias("c_mask"), _text(F.col("r")).alias("r"), _masks(F.col("r")).alias("r_mask"),
        ).alias("part"),
    )
    whole = parts.groupBy("pair_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    parts_ = F.col("parts")

    def total(name: str) -> Column:
        return F.aggregate(parts_, F.lit(0).cast("long"), lambda a, p: a + p[name])

    def text(name: str) -> Column:
        return F.array_join(F.transform(parts_, lambda p: p[name]), "")

    def mask(name: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(state: Column, p: Column) -> Column:
            m = p[name]
            moved = F.transform(m["spans"], lambda s: F.concat_ws(":", s["first"] + state["at"], s["last"] + state["at"]))
            return F.struct((state["at"] + m["at"]).alias("at"), F.concat(state["spans"], moved).alias("spans"))

        return F.array_join(F.aggregate(parts_, start, step)["spans"], ",")

    return whole.select(
        "pair_id", total("kept").alias("prompt_turns"), text("prompt").alias("prompt"),
        total("n_c").alias("chosen_turns"), text("c").alias("chosen"), mask("c_mask").alias("chosen_mask"),
        total("n_r").alias("rejected_turns"), text("r").alias("rejected"), mask("r_mask").alias("rejected_mask"),
    )


def paired_by_id(conversations: DataFrame) -> DataFrame:
    """Turns of conversations 2n as chosen and 2n + 1 as rejected of pair n."""
    return conversations.select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise(F.lit("rejected")).alias("side"),
        "turn", "role", "text",
    )
