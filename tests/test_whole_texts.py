"""Text queries over documents of all languages and all lines, against plain Python."""

import re

import pytest

from docflow.functions import entities
from docflow.operators import chunk
from docflow.plans import entity_queries, registry
from docflow.plans.common import markdown

EVERY = ["extract_dates", "extract_time_periods", "extract_metrics", "extract_regions", "extract_people", "extract_organizations", "populate_entities", "ner_rules", "clean_text"]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", EVERY)
def test_every_document(spark, sf, documents, name):
    assert {r.doc_id for r in registry.QUERIES[name](spark, sf).collect()} == set(documents)


def found(text, patterns, each, total, keep=bool):
    every = []
    for p in patterns:
        hits = [m.group().strip() for m in re.finditer("(?i)" + p, text)]
        every += [x for x in hits[:each] if keep(x)]
    return "|".join(sorted(list(dict.fromkeys(every))[:total]))


def year(x):
    return 1900 <= int(x) <= 2030 if len(x) == 4 and x.isdigit() else bool(x)


KINDS = {
    "extract_dates": (entities.DATES, None, 10, False), "extract_time_periods": (entities.TIME_PERIODS, 5, 8, True),
    "extract_metrics": (entities.METRICS, 8, 10, False), "extract_regions": (entities.REGIONS, 3, 5, True),
}


@pytest.mark.parametrize("name", KINDS)
def test_entities_in_all_languages(spark, sf, name):
    patterns, each, total, lower = KINDS[name]
    texts = {r.doc_id: r.t for r in entity_queries.text(spark, sf).collect()}
    want = {i: found(t.lower() if lower else t, patterns, each, total, year if name == "extract_dates" else bool) for i, t in texts.items()}
    assert {r.doc_id: r.found for r in registry.QUERIES[name](spark, sf).collect()} == want


def test_sentences_in_all_languages(spark, sf):
    got = {}
    for r in registry.QUERIES["sentences"](spark, sf).orderBy("doc_id", "block", "position").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    texts = {r.doc_id: r.text for r in markdown(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == {i: chunk.split_sentences(t) for i, t in texts.items()}


def test_heading_of_every_line(spark, sf):
    want = set()
    for r in markdown(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        lines = [x.strip() for x in r.text.split("\n")]
        heads = [(n, len(x) - len(x.lstrip("#")), x.lstrip("#").strip()) for n, x in enumerate(lines) if x.startswith("#") and x.lstrip("#").strip()]
        for n in range(len(lines)):
            _, level, heading = next((h for h in reversed(heads) if h[0] <= n), heads[0])
            want.add((r.doc_id, n, level, heading))
    assert {(r.doc_id, r.line_number, r.level, r.heading) for r in registry.QUERIES["heading_asof"](spark, sf).collect()} == want
