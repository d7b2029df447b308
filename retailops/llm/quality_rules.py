"""Quality rules by weak supervision.

Method.  Each rule votes good (1), bad (-1) or abstains (0) on a document.  Expectation-maximisation over the votes
estimates how each rule votes on good and on bad documents (its accuracies), without labels; a document is kept if its
posterior probability of being good reaches ``cut``, instead of having to pass all rules.

Scale.  Features and votes are Spark expressions in the reading task; only doc_id and numbers are stored, once.  EM needs
no documents: the votes of all rows are counted per vote pattern, at most 3 ** rules patterns whatever the corpus, and
the estimates come back as constants of an expression.  Nothing larger is collected, and the count is the only shuffle.

Defined results: NULL text has no words, symbols or lines and fails the base rules; so does an empty text; repeated rows
each give a row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, text_or_empty

NO = (math.inf, math.inf)  # never votes good: the absence of one kind of junk says little
#: name -> (feature, bad below, good from, good to, bad above); elsewhere the rule abstains.
RULES: dict[str, tuple[str, float, float, float, float]] = {
    "length": ("n_words", 50, 80, 200_000, math.inf),
    "word_size": ("word_chars / n_words", 2.0, 3.0, 12.0, 20.0),
    "sentences": ("n_stops / n_words", 0.004, 0.015, 0.40, 0.80),
    "symbols": ("n_symbols / n_words", -1, *NO, 0.15),
    "marks": ("n_marks / n_words", -1, *NO, 0.9),
    "variety": ("n_unique / n_words", 0.08, *NO, 2),
    "repeats": ("n_repeat_words / n_words", -1, *NO, 0.40),
    "lines": ("n_dup_lines / n_lines", -1, *NO, 0.40),
    "capitals": ("n_upper / word_chars", -1, *NO, 0.40),
    "shouting": ("n_exclaims / n_words", -1, *NO, 0.20),
}
#: First guess of how often a rule calls a good document bad, a bad one bad, a good one good, a bad one good.
START = (0.05, 0.60, 0.80, 0.60)
PRIOR_GOOD = 0.85
ROUNDS, WEIGHT = 60, 2.0


def _without(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, kept, ""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document, computed row by row."""
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    df = df.select("id", "text", F.array_remove(F.split("text", SPACE), "").alias("w"),
                   F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select("*", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_unique"), F.array_join("w", "").alias("solid"))
    three = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(
        F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    df = df.select("id", "text", "solid", "n_words", "n_unique", F.size("lines").cast("long").alias("n_lines"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                   F.when(F.size("w") >= 3, three).otherwise(F.array().cast("array<bigint>")).alias("win"))
    # Only texts in which a window occurs twice sort their windows to see which.
    df = df.withColumn("twice", F.size("win") > F.size(F.array_distinct("win")))
    df = df.withColumn("order", F.when(F.col("twice"), F.sort_array(F.transform(
        "win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, x: F.coalesce(F.get("order", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("hits", F.when(F.col("twice"), F.transform(F.filter(
        "order", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda i: F.array(i, i + 1, i + 2)))))
    return df.select(
        "id", "n_words", F.length("solid").cast("long").alias("word_chars"),
        _without(F.col("solid"), r"[^#*$%&|<>]+").cast("long").alias("n_symbols"), "n_dup_lines",
        F.when(F.col("twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"), "n_lines", "n_unique",
        _without(F.col("solid"), r"[\p{L}\p{M}\p{N}]+").cast("long").alias("n_marks"),
        _without(F.col("solid"), r"[^\p{Lu}]+").cast("long").alias("n_upper"),
        (F.length("solid") - F.length(F.replace("solid", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        (F.length("solid") - F.length(F.replace("solid", F.lit("."), F.lit("")))).cast("long").alias("n_stops"))


def vote(rule: tuple[str, float, float, float, float]) -> Column:
    """1, -1 or 0; a feature that is undefined (no words or lines) abstains."""
    feature, low, start, stop, high = rule
    top, _, bottom = feature.partition(" / ")
    x = F.col(top).cast("double")
    if bottom:
        x = x / F.nullif(F.col(bottom), F.lit(0)).cast("double")
    bad = (x < low) | (x > high) if high != math.inf else x < low
    return F.when(bad, -1).when((x >= start) & (x <= stop), 1).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int):
    """EM over counted vote patterns: (share of good documents, rates of each rule in the order of ``START``).

    The share stays at ``PRIOR_GOOD``: as abstentions say nothing, votes alone cannot place it.
    """
    total = sum(n for _, n in patterns)
    good, rates = PRIOR_GOOD, [START] * rules
    for _ in range(ROUNDS if total else 0):
        sums, mass = [[WEIGHT * x for x in START] for _ in range(rules)], 0.0
        for votes, n in patterns:
            p = posterior(votes, good, rates)
            mass += n * p
            for v, s in zip(votes, sums):
                if v:
                    s[1 + v] += n * p
                    s[2 + v] += n * (1 - p)
        each = (mass + WEIGHT, total - mass + WEIGHT) * 2
        rates = [tuple(x / m for x, m in zip(s, each)) for s in sums]
    return good, rates


def _weight(v: int, rate) -> float:
    """Log-odds that a vote adds for good; an abstention adds none."""
    return math.log(max(rate[1 + v], 1e-6) / max(rate[2 + v], 1e-6)) if v else 0.0


def posterior(votes, good: float, rates) -> float:
    s = math.log(good / (1 - good)) + sum(_weight(v, r) for v, r in zip(votes, rates))
    return 1 / (1 + math.exp(-s)) if s > -700 else 0.0


def judge(docs: DataFrame, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
          rules: dict[str, tuple[str, float, float, float, float]] = RULES) -> DataFrame:
    """Counts, ``base_failed``, the votes, ``p_good`` and ``kept`` per document."""
    names = [f"vote_{r}" for r in rules]
    seen = stored(features(docs, id_col, text_col).select("*", *[vote(r).alias(n) for n, r in zip(names, rules.values())]))
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in seen.groupBy(*names).count().collect()]
    good, rates = estimate(sorted(patterns), len(names))
    odds = F.lit(math.log(good / (1 - good)))
    for n, r in zip(names, rates):
        odds = odds + F.when(F.col(n) < 0, _weight(-1, r)).when(F.col(n) > 0, _weight(1, r)).otherwise(0.0)
    out = seen.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= cut)).withColumnRenamed("id", id_col)


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
