"""Operators that SQL does not express, on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docflow.config import ChunkConfig
from docflow.functions import encode, entities, text
from docflow.operators import chunk, clean, context, enrich, evaluate, maintenance, search, structure, tables
from docflow.plans.rag import RagPipeline, ingest
from docflow.sources import files, sinks
from docflow.streaming import events


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [_type(v) for v in values.values()], strict=True)))
    return row.select(column.alias("x")).first().x


def _type(v):
    return "array<string>" if isinstance(v, list) else {int: "int", float: "double"}.get(type(v), "string")


# Chunks


def test_sentences_join_lines_and_keep_headings(spark):
    body = "# Top\nFirst line\nends here. Next one!\n\nlast bit? yes\n## Sub\nTail. the end"
    assert chunk.split_sentences(body) == ["# Top", "First line ends here.", "Next one! last bit? yes", "## Sub", "Tail. the end"]
    rows = chunk.sentences(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("block", "position").collect()
    assert [r.sentence for r in rows] == chunk.split_sentences(body)


def sentence(rng, n):
    return " ".join(["W" + "o" * rng.randrange(1, 8) for _ in range(n)]) + "."


def test_pack_bounds_and_content():
    rng = random.Random(1)
    for _ in range(40):
        parts = [sentence(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 60))]
        chunks = chunk.pack(" ".join(parts))
        assert all(chunk.count_tokens(c) <= 512 + chunk.count_tokens(max(parts, key=len)) for c in chunks)
        left = " ".join(chunks)
        assert all(p in left for p in parts)
        at = 0
        for p in parts:  # sentences keep their order
            k = next(i for i, c in enumerate(chunks) if p in c)
            assert k >= at - 1
            at = max(at, k)


def test_overlap_is_a_fifth():
    parts = [("a", 30), ("b", 30), ("c", 50), ("d", 10), ("e", 90)]
    assert chunk.overlap_suffix(parts, 0.2) == []
    assert chunk.overlap_suffix(parts, 0.5) == [("d", 10), ("e", 90)]


def test_short_tail():
    rng = random.Random(2)
    body = " ".join([sentence(rng, 40) for _ in range(5)] + ["Tail here."])
    kept, legacy = chunk.pack(body), chunk.pack(body, ChunkConfig(keep_tail=False))
    assert kept[-1].endswith("Tail here.") and "Tail here." not in legacy[-1] or len(kept) == len(legacy)


def test_force_split():
    whole = "word " * 1000
    parts = chunk.force_split(whole)
    assert all(chunk.count_tokens(p) <= 512 for p in parts) and " ".join(parts).split() == whole.split()
    assert chunk.force_split("short") == ["short"]
    dotted = ("word " * 60 + "stop. ") * 20
    assert sum(p.endswith(".") for p in chunk.force_split(dotted)) >= 2


def test_chunk_udtf(spark):
    chunk.register_udtf(spark)
    rows = spark.sql("SELECT d.id, c.* FROM VALUES (1, 'One two. Three four.') AS d(id, t), LATERAL chunk_text(d.t) c").collect()
    assert [(r.id, r.chunk_index, r.content) for r in rows] == [(1, 1, "One two. Three four.")]


# Entities


def test_people_and_organizations(spark):
    t = "Dr. Alice Brown met tom. CEO Mary Ann spoke; The Company and Acme Big Blue Widget Corp. paid Inc"
    assert one(spark, entities.people(F.col("t")), t=t) == sorted(["Dr Alice Brown", "Alice Brown", "CEO Mary Ann", "Mary Ann", "Acme Big", "Big Blue", "Blue Widget", "Widget Corp"])
    assert one(spark, entities.organizations(F.col("t")), t=t) == ["Big Blue Widget Corp", "The Company"]
    assert one(spark, entities.organizations(F.col("t"), None, 4), t=t) == ["Acme Big Blue Widget Corp", "The Company"]


def test_dates(spark):
    t = "1/2/2020 2020-03-04 Jan 5, 2021 6 Feb 2021 Q3 2022 1899 1900 2030 2031 1/2/2020"
    assert one(spark, entities.dates(F.col("t")), t=t) == sorted({"1/2/2020", "2020-03-04", "Jan 5, 2021", "6 Feb 2021", "Q3 2022", "1900", "2030", "2020", "2021", "2022"})


# Text


def test_text_functions(spark):
    assert one(spark, text.document_title(F.col("p")), p="a/b/10-q4_as-filed.md") == "10 Q4 As Filed"
    assert one(spark, text.caption_heading(F.col("c")), c="The following table sets forth our net sales by region") == "Our Net Sales"
    assert one(spark, text.caption_heading(F.col("c")), c="The following table shows totals") == "Totals"
    assert one(spark, text.table_content(F.lit("T"), F.lit("C"), F.lit("C"), F.col("t")), t="x") == "T\n\nC\n\nx"
    assert one(spark, text.detect_format(F.col("t")), t='{"a": 1}') == "json"
    assert one(spark, text.detect_format(F.col("t")), t="# H one") == "markdown"
    assert one(spark, text.detect_format(F.col("t")), t="# H\ntext") == "mixed"
    assert one(spark, clean.clean_text(F.col("t")), t="Breadcrumb\n a  b \n\n\n\n**\nGLYPH<c=1>x GLYPH&lt;y") == "a b\n\n x GLYPH&lt;y"


def test_hashing_encoder(spark):
    v = one(spark, encode.hashing_encoder(F.col("t")), t="alpha beta alpha")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert set(one(spark, encode.hashing_encoder(F.col("t")), t=" ")) == {0.0}


# Structure and tables


def test_toc_candidates(spark):
    body = "\n".join(["Table of contents", "1. Intro", "2. More", "Intro .... 3", "More .... 9", "", "# Intro", "words " * 40, "# More", "words " * 40, *["plain line"] * 10])
    found = structure.toc_candidates(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()
    best = max(found, key=lambda r: r.score)
    assert (best.start_line, best.end_line, best.reason) == (0, 6, "keyword_triggered") and best.score > 1
    picked = structure.select_candidates(spark.createDataFrame(found))
    entries, heads = structure.toc_entries(spark.createDataFrame([(1, body)], "doc_id long, text string")), structure.headings(spark.createDataFrame([(1, body)], "doc_id long, text string"))
    sure = structure.confirm_by_headings(picked.drop("pick"), entries, heads).collect()
    assert max(r.score for r in sure) == pytest.approx(best.score + 0.1)


def layout():
    cell = lambda t: {"text": t}
    grid = [[cell("Year"), cell("Sales|net")], [cell("2024"), cell("5")], [cell("2023"), {}]]
    cells = [{"text": t, "start_row_offset_idx": r, "start_col_offset_idx": c} for r, row in enumerate([["PART I", "", "1"], ["Item 1", "Business", "3"], ["Page", "x", "9"]]) for c, t in enumerate(row)]
    texts = [{"self_ref": "#/texts/0", "text": "The following table shows sales", "page": 1}, {"self_ref": "#/texts/1", "text": "Table of contents and the following table", "prov": [{"page_no": 4}]}]
    return {"texts": texts, "tables": [{"self_ref": "#/tables/0", "label": "table", "prov": [{"page_no": 2}], "data": {"grid": grid, "table_cells": cells}}], "figures": [], "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/tables/0"}]}}


def test_layouts(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps(layout()))
    layouts = files.read_layouts(spark, str(tmp_path))
    t = tables.layout_tables(layouts).first()
    assert (t.doc_id, t.table_id, t.num_rows, t.num_cols, t.page, t.caption) == ("doc", "table_0", 3, 2, 2, "The following table shows sales")
    md = tables.layout_tables(layouts).select(tables.grid_to_markdown(F.col("grid")).alias("m")).first().m
    assert md == "| Year | Sales\\|net |\n| --- | --- |\n| 2024 | 5 |\n| 2023 |  |"
    elements = enrich.layout_elements(layouts).orderBy("idx").collect()
    assert [e.page for e in elements] == [1, 4, 2, 1, 4, 2]
    cells = layouts.select("doc_id", F.posexplode("layout.tables").alias("table_index", "t")).select("doc_id", "table_index", F.explode("t.data.table_cells").alias("c"))
    toc = structure.layout_toc(cells.select("doc_id", "table_index", F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("col"), "c.text")).orderBy("row").collect()
    assert [(r.level, r.page, r.confidence) for r in toc] == [(1, 1, 0.95), (2, 3, 0.9)] and toc[1].title == "Item 1 Business"


def test_table_parts(spark):
    rows = [("t", 0, "head", 20)] + [("t", i, f"row {i}", 100) for i in range(1, 12)] + [("s", 0, "head", 20), ("s", 1, "only", 5), ("e", 0, "head", 1)]
    got = tables.pack_rows(spark.createDataFrame(rows, "table_id string, row_index long, line string, tokens int")).orderBy("table_id", "part").collect()
    assert [(r.table_id, r.part, r.n_parts) for r in got] == [("e", 1, 1), ("s", 1, 1), ("t", 1, 3), ("t", 2, 3), ("t", 3, 3)]
    assert got[1].content == "head\nonly" and all(r.content.startswith("head") for r in got)


def test_fuzzy_match(spark):
    chunks = spark.createDataFrame([("c", 1, "The quick brown fox jumps over the lazy dog today and tomorrow", 1)], "chunk_id string, doc_id long, content string, page int")
    elements = spark.createDataFrame([(1, 0, "something else entirely here that has its own words, fifty+", 1), (1, 1, "The quick brown fox jumped over the lazy dog today and tomorrow", 1)], "doc_id long, idx int, text string, page int")
    m = enrich.match_fuzzy(chunks, elements).first()
    assert m.idx == 1 and 0.9 < m.confidence <= 1


# Search, evaluation, context


def test_search_plan_limits_each_task(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = search.batch_search(q, e, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_metrics(spark):
    run = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "b", 0.0), ("q", 3, "c", 0.1), ("n", 1, "a", 1.0)], "query_id string, rank int, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "c", 1), ("q", "z", 1), ("m", "a", 1), ("n", "a", 0)], "query_id string, doc_id string, relevance int")
    r = {(x.query_id, x.k): x for x in evaluate.per_query(run, qrels, (1, 3)).collect()}
    assert set(r) == {("q", 1), ("q", 3), ("m", 1), ("m", 3)}
    assert r["q", 3].precision == pytest.approx(2 / 3) and r["q", 3].recall == pytest.approx(2 / 3)
    assert r["q", 3].ap == pytest.approx((1 + 2 / 3) / 3) and 0 < r["q", 3].ndcg < 1 and r["m", 3].ndcg == 0


def test_qrels(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("query-id\tcorpus-id\tscore\nq\td\t1\n")
    (tmp_path / "b.tsv").write_text("q\t0\te\t2\n")
    assert sorted(map(tuple, evaluate.read_qrels(spark, str(tmp_path)).collect())) == [("q", "d", 1), ("q", "e", 2)]


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, r, n) for r, n in enumerate([5, 4, 9, 1])], "query_id int, rank int, n int")
    assert [r["rank"] for r in context.within_budget(rows, F.col("n"), 10).collect()] == [0, 1]


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    kept = maintenance.remove_duplicates(rows, ["k"], [F.col("id")])
    assert sorted(r.id for r in kept.collect()) == [1, 3]
    assert sorted(r.id for r in maintenance.remove_duplicates(kept, ["k"], [F.col("id")]).collect()) == [1, 3]
    assert [r.id for r in maintenance.remove_duplicates(rows, ["k"], [F.col("id")], dry_run=True).collect()] == [2]


# Files, store, streams


def test_ingest_and_rag(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "my-report.md").write_text("# Report\nRevenue grew 5% in 2024. " + "More words follow. " * 30)
    (tmp_path / "latin.txt").write_bytes("caf\xe9 au lait".encode("latin-1"))
    (tmp_path / "skip.yml").write_text("a: 1")
    docs = files.scan_documents(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(d.doc_id, d.title, d.source_type, list(d.folder_path)) for d in docs] == [("latin", "Latin", "md", []), ("my-report", "My Report", "md", ["sub"])]
    assert docs[0].text == "café au lait"
    chunks = ingest(spark, str(tmp_path))
    rows = {r.chunk_id: r for r in chunks.collect()}
    assert "my-report_chunk_1" in rows and rows["my-report_chunk_1"].dates == ["2024"] and len(rows["my-report_chunk_1"].embedding) == 64
    store = chunks.select(F.xxhash64("chunk_id").alias("vec_id"), F.col("chunk_id").alias("chunk_key"), "doc_id", F.lit("").alias("section"), "content", "embedding")
    answers = RagPipeline(store).query(spark.createDataFrame([(1, "revenue grew")], "query_id long, query string")).collect()
    assert len(answers) == 1 and answers[0].answer.startswith("[mock answer")


def test_store(spark, tmp_path):
    store = sinks.ChunkStore(spark, str(tmp_path / "store"), "chunk_id string, n int")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int")
    store.create()
    store.insert(rows)
    store.insert(rows.limit(1))
    assert store.count() == 3 and store.healthy() and store.stats().first().row_count == 3
    store.delete(rows.where("n = 1"), "chunk_id")
    assert [r.chunk_id for r in store.rows().collect()] == ["b"]
    with pytest.raises(ValueError):
        store.clear()
    assert store.clear(confirm=True) == (1, 0)


def test_file_stream_reads_each_file_once(spark, tmp_path):
    source, target, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    (source / "a.txt").write_text("one")
    events.ingest_files(spark, str(source), str(target), str(mark))
    (source / "b.txt").write_text("two")
    events.ingest_files(spark, str(source), str(target), str(mark))
    assert sorted(r.text for r in spark.read.parquet(str(target)).collect()) == ["one", "two"]


def test_event_streams(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").symlink_to(f"{sf}/events.parquet")
    stream = events.read_events(spark, str(tmp_path / "in"))
    batch = spark.read.parquet(f"{sf}/events.parquet")
    q = events.running_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: r.n for r in spark.sql("select * from totals").collect()}
    assert got == {r.user_id: r["count"] for r in batch.groupBy("user_id").count().collect()}
    q = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select start, event_type, n from windows").collect())) == sorted((r.start, r.event_type, r.n) for r in events.tumbling(batch).collect())
    assert events.deduplicated(stream).isStreaming
    events.log_batches(stream, str(tmp_path / "log"), str(tmp_path / "mark"))
    assert spark.read.json(str(tmp_path / "log")).count() == batch.count()


# Models, JSON contents, command line


class Names:
    def predict(self, texts):
        return [{"organizations": ["Acme Corp", "Windows 11", "the group", "Acme Corp"], "locations": ["Rome"], "products": ["Widget"]} for _ in texts]


class Lengths:
    def score(self, queries, contents):
        return [float(len(q) - len(c)) for q, c in zip(queries, contents, strict=True)]


class Sure:
    def confidence(self, sections):
        return [0.8 if "contents" in s else 0.1 for s in sections]


def test_models(spark):
    from docflow.operators import models

    chunks = spark.createDataFrame([("a", "x" * 60), ("b", "short")], "chunk_id string, content string")
    rows = {r.chunk_id: r.ner for r in models.with_ner(chunks, Names()).collect()}
    assert rows["a"].organizations == ["Acme Corp"] and rows["a"].products == ["Widget", "Windows 11"] and rows["b"].organizations == []
    text_rows = spark.createDataFrame([("a", "Big Blue Widget Corp. opened a plant in Germany, and it went very well indeed.")], "chunk_id string, content string")
    assert models.with_ner(text_rows).first().ner.locations == ["germany"]
    pairs = spark.createDataFrame([(1, "ab", "abc"), (2, "q", "q")], "i int, query string, content string")
    known = models.pair_scores(pairs.where("i = 1"), Lengths()).select("pair_key", F.lit(9.0).alias("logit"))
    assert sorted((r.i, r.logit) for r in models.pair_scores(pairs, Lengths(), known).collect()) == [(1, 9.0), (2, 0.0)]
    sections = spark.createDataFrame([(1, 0.6, "contents 1"), (2, 0.9, "other")], "id int, score double, body string")
    assert [(r.id, round(r.score, 6)) for r in models.verified(sections, F.col("body"), Sure()).collect()] == [(1, 1.0)]
    assert models.verified(sections, F.col("body")).count() == 2
    titled = models.table_titles(spark.createDataFrame([("t", "The following table shows net sales", "| a |")], "table_id string, caption string, markdown string")).first()
    assert (titled.title, titled.summary) == ("Net Sales", "shows net sales")
    base = models.benchmark(lambda: None, 2)
    assert base["min"] <= base["mean"] <= base["max"] and models.overhead_pct({"mean": 2.0}, {"mean": 3.0}) == 50


def test_json_contents(spark):
    from docflow.operators.json_toc import json_contents

    body = {"meta": {"toc": [{"title": "A", "page": "3"}, {"name": "B", "level": 2}]}, "Chapters": [{"title": "C", "id": 7, "subsections": [{"name": "D"}]}, {"page_number": 5}], "x": [{"parts": [{"title": "E"}]}]}
    rows = json_contents(spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None)], "doc_id long, text string")).collect()
    assert [(r.level, r.title, r.page, r.section_id, r.confidence) for r in rows] == [(1, "A", 3, None, 0.95), (2, "B", None, None, 0.95), (1, "C", None, "7", 0.9), (2, "D", None, None, 0.9), (1, "Section 2", 5, None, 0.9), (1, "E", None, None, 0.9)]


def test_command_line_parses():
    from docflow.__main__ import parse

    assert parse(["ingest", "--input-dir", "a", "--output-dir", "b"]).verb == "ingest"
    assert not parse(["dedupe", "--input", "a", "--key", "k", "--order", "o"]).confirm


def test_scratch(spark):
    import os

    from docflow.session import checkpoint_dir, clear_scratch, materialize

    kept = materialize(spark.range(3), "numbers")
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2]
    clear_scratch(spark)
    assert not os.path.exists(checkpoint_dir(spark).removeprefix("file://") + "/docflow")
