"""Quality rules: a decision list, learned by sequential covering, as ordered Spark conditional expressions.

The base statistics of every document come from text_stats. Documents that fail the fixed base rules are rejected; the rest
goes through the list: the first rule whose thresholds all hold rejects a document, and a document that no rule takes is kept.

Learning reads a bounded sample of labelled documents (max_labelled, by hash of id). Each rule is grown condition by condition
on two thirds of it (information gain as in FOIL) and pruned on the rest; covering stops when a rule's precision on the pruning
rows falls below min_precision or no junk row is left.

Defined cases: a null text counts as empty (n_words 0, so base_failed); null ids are kept as rows; repeated rows get equal
results each; without labelled rows of both kinds the list is empty and only the base rules decide; an empty table gives no rows;
other columns of docs are carried if named, but for those named like an output column, which it replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bundled
from .text_stats import BASE, RATIOS, labelled_sample, with_base_stats, with_ratios

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MADE = [*BASE, *RATIOS, "base_failed", "rule", "kept"]


@dataclass(frozen=True)
class Condition:
    """feature >= threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, row) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _holds(rule: Rule, row) -> bool:
    return all(c.holds(row) for c in rule)


def _counts(rule: Rule, rows: list) -> tuple[int, int]:
    """Junk and good rows that the rule takes."""
    taken = [r["k_label"] for r in rows if _holds(rule, r)]
    return taken.count(0), len(taken) - taken.count(0)


def _best_condition(rows: list, features: list[str]) -> Condition | None:
    """The condition with the largest information gain over rows, thresholds between neighbouring values."""
    junk = sum(r["k_label"] == 0 for r in rows)
    good = len(rows) - junk
    if not junk or not good:
        return None
    before = math.log2(junk / (junk + good))
    best, gain = None, 1e-9
    for f in features:
        values = sorted((r[f], r["k_label"]) for r in rows)
        below_junk = below_good = 0
        for (value, label), (following, _) in zip(values, values[1:]):
            below_junk += label == 0
            below_good += label != 0
            if value == following:
                continue
            cut = (value + following) / 2
            for above, p, n in ((False, below_junk, below_good), (True, junk - below_junk, good - below_good)):
                if p and (g := p * (math.log2(p / (p + n)) - before)) > gain:
                    best, gain = Condition(f, above, cut), g
    return best


def _grow(rows: list, features: list[str], max_conditions: int) -> Rule:
    rule: Rule = ()
    while len(rule) < max_conditions and (c := _best_condition(rows, features)):
        rule += (c,)
        rows = [r for r in rows if c.holds(r)]
    return rule


def _prune(rule: Rule, rows: list) -> Rule:
    """The prefix with the best (junk - good) / (junk + good) on rows; the shorter of equals."""

    def worth(k: int) -> float:
        p, n = _counts(rule[:k], rows)
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (round(worth(k), 9), -k))] if rule else rule


def learn_rules(rows: list, features: list[str] = RATIOS, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_taken: int = 3) -> list[Rule]:
    """Sequential covering over labelled rows (mappings with the features and k_label; 0 is junk)."""
    rows = sorted(rows, key=lambda r: (r["k_label"], *[r[f] for f in features]))
    held, grown = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    found: list[Rule] = []
    while len(found) < max_rules:
        rule = _prune(_grow(grown, features, max_conditions), held)
        if not rule:
            break
        p, n = _counts(rule, grown + held)
        ph, nh = _counts(rule, held)
        if p < min_taken or p < min_precision * (p + n) or ph < min_precision * (ph + nh):
            break
        found.append(rule)
        grown, held = ([r for r in part if not _holds(rule, r)] for part in (grown, held))
    return found


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that takes a row, from 1; null if none does."""
    fired = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        every = F.lit(True)
        for c in rule:
            every = every & c.column()
        fired = F.when(every, F.lit(i)).otherwise(fired)
    return fired


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, min_precision: float = 0.95, carry: list[str] = []) -> DataFrame:
    """One row per row of docs: doc_id, text, the columns in carry, the base statistics, the ratios, base_failed, rule and kept."""
    sample = with_ratios(with_base_stats(labelled_sample(docs, labels, "quality", max_labelled)))
    rows = sample.select("k_label", base_failed().alias("out"), *RATIOS).collect()  # max_labelled rows at most
    rules = learn_rules([r for r in rows if not r["out"]], min_precision=min_precision)
    rows, carried, kept = bundled(docs, carry, ["doc_id", "text", *MADE])
    judged = with_ratios(with_base_stats(rows.select("doc_id", "text", carried))).withColumn("base_failed", base_failed()).withColumn("rule", first_rule(rules))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return judged.select("doc_id", "text", *[F.col(f"{carried}.`{c}`").alias(c) for c in kept], *MADE)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
