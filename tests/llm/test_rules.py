"""op10 against a plain count in Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

from docflow.llm import queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    n = sum(map(len, w))
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    verdict = not (
        10 * symbols > len(w) or 2 * sum(c.isupper() for c in text) > n or 2 * text.count("!") > len(w)
        or 2 * (len(lines) - len(set(lines))) > len(lines) or n < 2 * len(w) or n > 15 * len(w)
    )
    return len(w), n, symbols, len(lines) - len(set(lines)), len(covered), base, not base and verdict


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_rule_cascade(spark, sf).collect()
    assert {r.doc_id: columns(r) for r in rows} == {i: measure(t) for i, t in texts.items()}


def test_odd_texts(spark):
    odd = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d", "a b c " * 4000, " ".join(map(str, range(20000))), "é" * 9 + " ñ", "l\nl\n \nl", "a\r\nb\x0bc\x0cd\x1ce", "WORD!! " * 60]
    docs = spark.createDataFrame(list(enumerate(odd)) + [(2, odd[5])], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = sorted((r.doc_id, columns(r)) for r in rules.judge(docs).collect())
    assert got == sorted([(i, measure(t)) for i, t in enumerate(odd)] + [(2, measure(odd[5]))])
    assert rules.judge(docs.limit(0)).count() == 0
    kept = rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in enumerate(odd) if measure(t)[-1])


def test_order(spark):
    docs = spark.createDataFrame([(i, "w " * i) for i in range(100)], "doc_id long, text string")
    never = rules.Rule("never", lambda t: rules.repeated_windows(t) & F.lit(False))
    ordered = rules.order_by_rejections(docs, (never, rules.BASE_RULES[0]))
    assert [r.name for r, _, _ in ordered] == ["few_words", "never"] and ordered[0][2] == 0.5
