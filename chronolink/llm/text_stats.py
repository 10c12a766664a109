"""Whole-text statistics as DataFrame expressions, without Python on executors.

Null texts count as empty. Statistics of an empty text are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolink.llm.common import GAP, WORD, words

#: Words of a window whose repetition within a text counts.
REPEAT_WINDOW = 8


def _repeated_words(hashes: Column, width: int) -> Column:
    """Words covered by windows that occur twice or more: hashes holds a window's hash per start.

    Only for texts with a repetition: sorts (hash, start), keeps starts whose
    neighbour has the same hash, and adds up the words that each start covers
    before the next.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        n = F.size(p)
        same = F.filter(
            p,
            lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(p, k + 1)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(s: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(s, first, step, lambda a: a["n"])

    one = F.transform(F.array(pairs), starts)
    return F.transform(one, covered)[0]


def _chars(text: Column, pattern: str) -> Column:
    """Characters of a class in a text: what is left when the others go."""
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), more: bool = True) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and with more the counts that models use.

    n_upper, n_digits, n_marks (!?), n_bars (|), n_stops (.,;:), n_lines,
    n_chars and n_distinct (distinct words).
    """
    w, t = F.col("__words"), F.col("__text")
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    base = base.withColumn("__words", words(t))
    n = F.size(w)
    hashes = F.when(
        n >= REPEAT_WINDOW, F.transform(F.sequence(F.lit(1), n - (REPEAT_WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, REPEAT_WINDOW)))
    ).otherwise(F.array().cast("array<long>"))
    base = base.withColumn("__hashes", hashes)
    h = F.col("__hashes")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    extra = [
        _chars(t, r"\P{Lu}+").alias("n_upper"), _chars(t, r"[^0-9]+").alias("n_digits"), _chars(t, r"[^!?]+").alias("n_marks"),
        _chars(t, r"[^|]+").alias("n_bars"), _chars(t, r"[^.,;:]+").alias("n_stops"), F.size(F.col("__lines")).cast("long").alias("n_lines"),
        F.char_length(t).cast("long").alias("n_chars"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
    ]
    base = base.withColumn("__lines", lines)
    return base.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
        _chars(t, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated_words(h, REPEAT_WINDOW)).otherwise(0).cast("long").alias("n_repeat_words"),
        *(extra if more else []),
    )
