"""Quality rules with a bitmask ledger.

Every document is measured once and every rule judged once: the ledger holds the
measurements and one integer with a bit per failed rule. A policy is a version and a mask of
the rules that reject; applying another policy, or asking what a rule alone removes, reads
the ledger and never a text.

A text stays in its row: repeated windows are found by sorting the row's own window digests
(64 bits, xxhash64), so nothing is shuffled and no key can be hot. Built-in functions only.

Rows: null text counts as empty; an empty text has no words and fails `few_words`; a null
or repeated `doc_id` stays as it is; an empty table gives no rows; of extra columns only those
named in `keep` are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, and the characters counted as symbols.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
SYMBOL_CLASS = r"[#*$%&|<>]"
CAPITAL_CLASS = r"[^A-ZÀ-ÖØ-Þ]+"


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`n_words`, `word_chars`, `n_symbols`, `n_lines`, `n_dup_lines`, `n_repeat_words`,
    `n_capitals`, `n_chars` of each text, all long. A line counts if it has a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("_text"))
    trimmed = F.btrim(F.col("_text"), F.lit(SPACES))
    split = base.select(
        *keep,
        "_text",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"),
    )
    counted = split.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", f"{SYMBOL_CLASS}+", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("_text", CAPITAL_CLASS, "")).cast("long").alias("n_capitals"),
        F.length("_text").cast("long").alias("n_chars"),
        F.when(
            F.size("_words") >= 3,
            F.expr("transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))"),
        ).alias("_windows"),
    )
    # Only texts in which some window occurs twice need the places.
    places = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    sorted_ = counted.select("*", places.alias("_places")).drop("_windows")
    twice = F.expr("filter(_places, (p, k) -> get(_places, k - 1).h = p.h or get(_places, k + 1).h = p.h)")
    starts = sorted_.select("*", F.sort_array(F.transform(twice, lambda p: p["i"])).alias("_starts")).drop("_places")
    covered = F.expr(
        "aggregate(transform(_starts, (s, k) -> least(3, coalesce(get(_starts, k + 1) - s, 3))), 0L, (a, b) -> a + b)"
    )
    return starts.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("_starts")


# Failing conditions by name; the place in this order is the bit. New rules go at the
# end, so that stored ledgers stay readable.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "100 * n_capitals > 40 * n_chars",
}


def bit(*names: str) -> int:
    order = list(RULES)
    return sum(1 << order.index(name) for name in names)


BASE = bit("few_words", "repeated_windows")
# Policies by version: the rules that reject.
POLICIES = {
    1: BASE,
    2: bit(*RULES),
}
CURRENT = 2


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and `failed`, one bit per rule."""
    bits = [F.when(failing, F.lit(1 << i)).otherwise(F.lit(0)) for i, failing in enumerate(map(F.expr, RULES.values()))]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs, keep).withColumn("failed", failed.cast("long"))


def verdict(version: int = CURRENT, failed: Column | None = None) -> Column:
    """Whether a policy keeps a row of the ledger."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(POLICIES[version])) == 0


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone (so the policy without it
    would keep them), and rows kept with and without it. One pass over the ledger."""
    mask = POLICIES[version]
    names = [(i, name) for i, name in enumerate(RULES) if mask >> i & 1]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(hit == 0).alias("kept")]
    for i, _ in names:
        sums += [F.count_if(hit.bitwiseAND(F.lit(1 << i)) != 0).alias(f"any{i}"), F.count_if(hit == (1 << i)).alias(f"only{i}")]
    one = rows.agg(*sums)
    lines = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"any{i}").alias("failing"),
            F.col(f"only{i}").alias("failing_alone"),
            F.col("kept").alias("kept"),
            (F.col("kept") + F.col(f"only{i}")).alias("kept_without"),
        )
        for i, name in names
    ]
    return one.select(F.explode(F.array(*lines)).alias("_r")).select("_r.*")


def keep_good(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The documents, all columns, that a policy keeps."""
    rows = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), ("_row",))
    # A filter would be pushed below the measurements and repeat them in its condition,
    # each inside the other; beside a row number it stays where it is.
    numbered = rows.withColumn("_n", F.monotonically_increasing_id())
    return numbered.filter(verdict(version) & (F.col("_n") >= 0)).select("_row.*")
