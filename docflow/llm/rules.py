"""Quality rules as a short-circuit cascade: each rule's cost and selectivity are estimated on a bounded sample, and the rules run
in the order of rejections per cost. DataFrame functions only.

Every measure is an expression over one row's text, so nothing is shuffled and a text of any length stays in its task.

Defined results: a null text is an empty one: it has no words and base_failed; repeated rows are judged each; other columns are
ignored (`kept_documents` returns them as they are); an empty table gives no rows and leaves the rules in the given order.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Documents of the sample from which costs and selectivities are estimated.
SAMPLE_ROWS = 1000
SEED = 11


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long")


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more.

    A window is a 64-bit hash whose low bits give way to its position, so that one sort of longs brings equal windows together;
    neighbours with equal high bits are then compared word by word, and only where these differ with all that have these bits.
    """

    def windows(w: Column, bits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), bits).bitwiseOR(i.cast("long")))

    def found_twice(w: Column, bits: Column, ordered: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        high = lambda x: F.call_function("shiftright", x, bits)
        at = lambda x: x.bitwiseAND(mask).cast("int")

        def equal(x: Column, y: Column) -> Column:
            same = lambda a, b: (w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2])
            return F.when(high(x) == high(y), same(at(x), at(y))).otherwise(False)

        def twice(x: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1), F.get(ordered, i + 1)
            near = F.coalesce(equal(x, before), F.lit(False)) | F.coalesce(equal(x, after), F.lit(False))
            other = F.coalesce(high(x) == high(before), F.lit(False)) | F.coalesce(high(x) == high(after), F.lit(False))
            return F.when(near, True).when(other, F.exists(ordered, lambda y: (y != x) & equal(x, y))).otherwise(False)

        return F.transform(F.filter(ordered, twice), at)

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def whole(w: Column) -> Column:
        bits = F.ceil(F.log2(F.size(w) + 1)).cast("int")
        return let(bits, lambda b: let(F.array_sort(windows(w, b)), lambda o: let(F.array_sort(found_twice(w, b, o)), covered)))

    return F.when(F.size(words) >= 3, whole(words)).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """rejects(document) is true for a document that goes; it has the fields text, never null, and words."""

    name: str
    rejects: Callable[[Column], Column]


def document(text: Column) -> Column:
    """What rules judge: the words are split once for all of them."""
    return F.struct(text.alias("text"), words_of(text).alias("words"))


def few_words(d: Column) -> Column:
    return F.size(d["words"]) < 50


def repeated_windows(d: Column) -> Column:
    return let(d["words"], lambda w: 100 * repeat_words(w) > 50 * F.size(w))


def many_symbols(d: Column) -> Column:
    return 10 * n_symbols(d["text"]) > F.size(d["words"])


def shouting(d: Column) -> Column:
    """Over half of the characters of words are upper-case letters."""
    return 2 * F.length(F.regexp_replace(d["text"], r"\P{Lu}+", "")) > word_chars(d["text"])


def exclaiming(d: Column) -> Column:
    return 2 * F.length(F.regexp_replace(d["text"], "[^!]+", "")) > F.size(d["words"])


def repeated_lines(d: Column) -> Column:
    return let(lines_of(d["text"]), lambda x: 2 * dup_lines(x) > F.size(x))


def odd_word_length(d: Column) -> Column:
    """Words of under 2 or over 15 characters on average."""
    return let(F.struct(word_chars(d["text"]).alias("chars"), F.size(d["words"]).alias("n")), lambda x: (x["chars"] < 2 * x["n"]) | (x["chars"] > 15 * x["n"]))


BASE_RULES = (Rule("few_words", few_words), Rule("repeated_windows", repeated_windows))
RULES = (Rule("many_symbols", many_symbols), Rule("shouting", shouting), Rule("exclaiming", exclaiming), Rule("repeated_lines", repeated_lines), Rule("odd_word_length", odd_word_length))


def order_by_rejections(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in the order of rejections per second, from a sample of sample_rows documents at most.

    Every document has the same chance to be in the sample, whatever its partition, and the sample is as large for any table. The
    order changes no verdict, only the work: a document is rejected if any rule rejects it.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    chosen = docs.select(F.coalesce("text", F.lit("")).alias("text")).sample(share, SEED).limit(sample_rows)
    sample = materialize(chosen, "rules-sample")

    def timed(rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        found = sample.agg(F.count_if(rejects), F.count("*")).first()
        return time.perf_counter() - began, found[0] / max(found[1], 1)

    timed(F.length("text") < 0)
    idle = min(timed(F.length("text") < 0)[0] for _ in range(2))
    found = []
    for rule in rules:
        seconds, share = timed(let(document(F.col("text")), rule.rejects))
        found.append((rule, max(seconds - idle, 1e-3), share))
    return sorted(found, key=lambda x: -x[2] / x[1] if not math.isnan(x[2]) else 0)


def cascade(text: Column, rules: list[Rule]) -> Column:
    """True if no rule rejects the text; a rule is computed only for texts that those before it let pass."""

    def verdict(d: Column) -> Column:
        out = F.lit(True)
        for rule in reversed(rules):
            out = F.when(rule.rejects(d), F.lit(False)).otherwise(out)
        return out

    return let(document(text), verdict)


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    ordered = [r for r, _, _ in order_by_rejections(docs, rules, sample_rows)]
    return docs.where(cascade(F.coalesce("text", F.lit("")), ordered))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    ordered = [r for r, _, _ in order_by_rejections(docs, rules, sample_rows)]
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"), let(lines_of(F.col("text")), dup_lines).alias("n_dup_lines"),
    )
    measured = base.select("doc_id", "text", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(cascade(F.col("text"), ordered)).alias("kept"))
