"""Quality rules as a ledger: each text is measured once, each rule leaves one bit.

Policies are versioned sets of rules, so a verdict is a bitwise test of stored bits, and what a
rule alone decides is a count by bits. No text is read again for either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import let, words

WINDOW = 3

# A rule's position is its bit; rules are added at the end and never change, so old bits stay valid.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 100000",
    "short_words": "10 * word_chars < 25 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "capitals": "10 * n_upper > 3 * word_chars",
    "bullets": "10 * n_bullet_lines > 9 * n_lines",
    "ellipses": "10 * n_ellipsis_lines > 3 * n_lines",
}
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "many_words", "symbols", "duplicate_lines", "capitals"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(rule) for rule in rules)


def repeated_words(w: Column) -> Column:
    """How many of the words lie in a three-word window that occurs twice or more.

    Windows are told apart by 64-bit hashes. Sorting (hash, place) brings equal windows together;
    their places, in order, then cover up to three words each.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(places) - 1),
            F.lit(0),
            lambda total, k: total
            + F.least(
                F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - F.get(places, k), F.lit(WINDOW))
            ),
        )

    def repeated(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, k: (x["h"] == F.get(ordered, k + 1)["h"])
            | ((k > 0) & (x["h"] == F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"])),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(ordered, repeated), covered)
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(w) > WINDOW, let(windows, count)).otherwise(F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements of each row's text, and ``failures``, one bit a failed rule.

    Null and empty texts have no words and measure 0 everywhere; they fail few_words alone.
    Repeated rows are measured alike; other columns are ignored. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    per_text = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    per_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda line: line.rlike(r"^[\x20\x09]*[-*•]")))
            .cast("long")
            .alias("n_bullet_lines"),
            F.size(F.filter(x, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09\r]*$")))
            .cast("long")
            .alias("n_ellipsis_lines"),
        ),
    )
    measured = docs.select(
        "doc_id",
        per_text.alias("__words"),
        per_line.alias("__lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
    ).select("doc_id", "__words.*", "__lines.*", "n_symbols", "n_upper")
    bits = [
        F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failures", total.cast("int"))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger with base_failed and kept under a policy."""
    failed = F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0
    verdict = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that fail it alone and would come back.

    Rows are first counted by their bits, of which there are at most 2 ** rules.
    """
    bits = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version])))
    counts = rows.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    numbered = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(mask((rule,))).alias("bit"))
            for rule in POLICIES[version]
        ]
    )
    each = counts.select("bits", "n", F.explode(numbered).alias("r")).select(
        "bits", "n", F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")
    )
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
    )
