"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule. Policies are versioned sets of rules: applying one, or asking what each of its rules
does on its own, is integer arithmetic on the stored bits, without a second look at the text.

Measuring is a single narrow pass of array expressions: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.once import computed_once
from palisade.llm.text import free_names, words_of

WINDOW = 5
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters", "n_exclaims", "n_upper",
]


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true. Its bit is its place in the list."""

    name: str
    fails: str


#: All thresholds are shares, so they mean the same for a short text and for a very long one.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("stutter", "5 * n_stutters > n_words"),
    Rule("exclamations", "3 * n_exclaims > n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
)
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(r.name for r in RULES)}
PRODUCTION = "v1"


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    place = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(place[n] for n in set(names))


def _measured(df: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """``df`` and the measurements, under the returned names (in the order of MEASURES)."""
    words, windows, pairs, places, has = free_names(df, "__words", "__windows", "__pairs", "__places", "__repeats")
    names = free_names(df, *[f"__m_{m}" for m in MEASURES])
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = computed_once(df, **{words: words_of(value)})
    w = F.col(words)
    hashed = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = computed_once(
        df,
        **{
            windows: hashed,
            names[0]: F.size(w).cast("long"),
            names[1]: F.length(F.array_join(w, "")).cast("long"),
            names[2]: F.regexp_count(value, F.lit("[#*$%&|<>]")).cast("long"),
            names[3]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            names[5]: F.size(lines).cast("long"),
            names[6]: F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long"),
            names[7]: F.regexp_count(value, F.lit("!")).cast("long"),
            names[8]: F.regexp_count(value, F.lit("\\p{Lu}")).cast("long"),
        },
    ).drop(words)
    h = F.col(windows)
    # Only a text with a repeated window needs its windows sorted.
    df = computed_once(df, **{has: F.size(F.array_distinct(h)) < F.size(h)})
    df = computed_once(
        df, **{pairs: F.when(F.col(has), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))}
    ).drop(windows, has)
    p = F.col(pairs)
    repeated = F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]))
    df = computed_once(df, **{places: F.sort_array(F.transform(repeated, lambda x: x["i"]))}).drop(pairs)
    at = F.col(places)
    covered = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return computed_once(df, **{names[4]: F.coalesce(total, F.lit(0).cast("long"))}).drop(places), names


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, out: str = "ledger") -> DataFrame:
    """``docs`` with one struct column ``out``: the measurements and ``fail_bits``.

    A null text counts as an empty one: all measurements are 0, and the rules see zeros. Rows are
    judged one by one, so repeated rows, ties and an empty table need no special treatment. All
    other columns are kept; a column of ``docs`` that is called ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    df, names = _measured(docs, text)
    measures = F.struct(*[F.col(n).alias(m) for n, m in zip(names, MEASURES)])
    df = df.select(*[F.col(f"`{c}`") for c in kept], measures.alias(out))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        fails = F.expr(_over_struct(rule.fails, out))
        bits = bits + F.when(fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return df.withColumn(out, F.col(out).withField("fail_bits", bits))


def _over_struct(sql: str, struct: str) -> str:
    return re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{struct}`.\1", sql)


def passes(
    policy: str, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES, column: str = "ledger"
) -> Column:
    """True where no rule of the policy failed; reads only the stored bits."""
    return F.col(column)["fail_bits"].bitwiseAND(F.lit(mask_of(policies[policy], rules)).cast("long")) == 0


def ablations(
    judged: DataFrame, policy: str, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """What each rule of a policy does: rows it fails, rows only it fails, rows kept without it, rows kept with all.

    Rows are first counted per bit pattern (map-side combined), so the rules are compared on at most
    2^rules counts. An empty ledger gives one row of zeros per rule.
    """
    mask = mask_of(policies[policy], rules)
    counts = judged.groupBy(F.col("ledger.fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("long")
    chosen = [(i, r) for i, r in enumerate(rules) if r.name in policies[policy]]
    sums = []
    for i, r in chosen:
        bit = F.lit(1 << i).cast("long")
        rest = F.lit(mask & ~(1 << i)).cast("long")
        sums += [
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))), zero).alias(f"f{i}"),
            F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), zero).alias(f"o{i}"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(rest) == 0, F.col("n"))), zero).alias(f"k{i}"),
        ]
    sums.append(F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("n"))), zero).alias("kept"))
    rows = F.array(
        *[
            F.struct(
                F.lit(policy).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"f{i}").alias("failed"),
                F.col(f"o{i}").alias("failed_alone"), F.col(f"k{i}").alias("kept_without"), F.col("kept"),
            )
            for i, r in chosen
        ]
    )
    return counts.agg(*sums).select(F.inline(rows))
