"""Learned decision lists for quality: sequential covering over labelled statistics.

Rules that reject are grown one threshold at a time by information gain on two
thirds of the labelled rows, pruned from the end on the other third, and kept
while they are precise; the rows that a rule covers leave before the next is
grown. All counts are DataFrame aggregates over all labelled rows, binned once
by a grid of quantiles; the driver gets a histogram of fixed size per step. The
list comes out as an ordered Spark conditional expression.

Defined results: null texts have no words and fail the base rules; a table
without labels, or with labels of one kind, gives an empty list that keeps
whatever passes the base rules; rows with null labels are no examples; NaN can't
occur, as ratios of empty texts are 0; repeated rows count as often as they
occur; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolink.llm.common import store
from chronolink.llm.text_stats import with_statistics

#: Features of a rule's conditions, as SQL over the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "n_words": "cast(n_words as double)",
}

BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expr(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list rejects: CASE WHEN rule THEN false ... ELSE true."""
    out = None
    for rule in rules:
        whole = rule[0].expr()
        for c in rule[1:]:
            whole = whole & c.expr()
        out = F.when(whole, F.lit(False)) if out is None else out.when(whole, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(labelled: DataFrame, rows: int, label: str = "quality", bad: int = 0, bins: int = 32, most_rules: int = 16, most_conditions: int = 3, precision: float = 0.97) -> list[Rule]:
    """Rules for rows whose label is bad. labelled: statistics with a label, of about so many rows.

    bins: quantiles per feature and class in the grid of thresholds.
    """
    values = labelled.where(F.col(label).isNotNull() & ~F.expr(BASE_FAILED)).select(
        (F.col(label) == bad).alias("__bad"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("__prune"),
        *[F.expr(e).alias(f) for f, e in FEATURES.items()],
    )
    files = max(1, rows // 200_000)  # not a file per shuffle partition
    values = store(values.repartition(files), "rules-values")
    points = [(i + 0.5) / bins for i in range(bins)]
    grid_rows = values.groupBy("__bad").agg(*[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES]).collect()
    if len(grid_rows) < 2:
        return []
    grid = {f: sorted({x for r in grid_rows for x in r[f]}) for f in FEATURES}

    def cell(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, grid[f])), lambda t: t <= F.col(f))).alias(f)

    cells = [cell(f) for f in FEATURES]
    binned = store(values.select("__bad", "__prune", *cells).groupBy("__bad", "__prune", *FEATURES).agg(F.count(F.lit(1)).alias("__n")).repartition(files), "rules-binned")

    def within(rule: list[tuple[str, bool, int]]) -> Column:
        """A condition is (feature, above, k): at least, or less than, grid value k; bins count grid values up to the value."""
        out = F.lit(True)
        for f, above, k in rule:
            out = out & ((F.col(f) > k) if above else (F.col(f) <= k))
        return out

    def histogram(rows: DataFrame) -> dict[str, list[list[float]]]:
        """Per feature and bin the [good, bad] rows of the growing part."""
        long = rows.where(~F.col("__prune")).select(
            "__bad", "__n", F.explode(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])).alias("__f", "__k")
        )
        out = {f: [[0, 0] for _ in range(len(grid[f]) + 1)] for f in FEATURES}
        for r in long.groupBy("__f", "__k", "__bad").agg(F.sum("__n")).collect():
            out[r[0]][r[1]][int(r[2])] += r[3]
        return out

    rules: list[Rule] = []
    left = binned
    for _ in range(most_rules):
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < most_conditions:
            counts = histogram(left.where(within(rule)))
            some = next(iter(counts.values()))
            n0, p0 = sum(c[0] for c in some), sum(c[1] for c in some)
            if not p0 or not n0:
                break
            best, chosen = 1e-9, None
            for f, cs in counts.items():
                low_n = low_p = 0
                for k in range(len(cs) - 1):
                    low_n, low_p = low_n + cs[k][0], low_p + cs[k][1]
                    for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                        if (g := _gain(p, n, p0, n0)) > best:
                            best, chosen = g, (f, above, k)
            if chosen is None:
                break
            rule.append(chosen)
        if not rule:
            break
        prefixes = [within(rule[: i + 1]) for i in range(len(rule))]
        sums = left.agg(*[F.coalesce(F.sum(F.when(x & (F.col("__bad") == b) & (F.col("__prune") | F.lit(whole)), F.col("__n"))), F.lit(0)) for x in prefixes for b in (True, False) for whole in (False, True)]).first()
        scored = []
        for i in range(len(rule)):
            p, p_all, n, n_all = sums[4 * i : 4 * i + 4]
            scored.append(((p - n) / (p + n) if p + n else -1.0, -i, p_all, n_all))
        worth, minus_i, p_all, n_all = max(scored)
        if p_all < 3 or p_all / (p_all + n_all) < precision:
            # a precise rule may need all its conditions
            worth, minus_i, p_all, n_all = max(scored, key=lambda s: s[2] / (s[2] + s[3] + 1))
            if p_all < 3 or p_all / (p_all + n_all) < precision:
                break
        rule = rule[: 1 - minus_i]
        rules.append(tuple(Condition(f, above, grid[f][k]) for f, above, k in rule))
        left = left.where(~within(rule))
    return rules


def _learned(stats: DataFrame, labels: DataFrame, **learning) -> list[Rule]:
    """The list learned from the rows of stored statistics that have a label."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id"), "quality").distinct()
    return learn_rules(stats.join(known, "doc_id"), known.count(), **learning)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", **learning) -> tuple[DataFrame, list[Rule]]:
    """Statistics of every row of docs with base_failed and kept, and the learned list.

    The rules are learned from docs' rows that have a label.
    """
    stats = store(with_statistics(docs, text), "rules-stats")
    rules = _learned(stats, labels, **learning)
    failed = F.expr(BASE_FAILED)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules)), rules


def keep_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that judge() keeps, with their columns.

    Rows are stored once beside their statistics, from which the list is learned
    and by which they are then filtered: no statistic is computed twice, and no
    text is shuffled at any size.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    stored = store(with_statistics(rows, "text", keep=("__row", "doc_id")), "rules-rows")
    rules = _learned(stored.drop("__row"), labels)
    return stored.where(~F.expr(BASE_FAILED) & verdict(rules)).select("__row.*")
