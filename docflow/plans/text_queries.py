"""Scalar functions, filters, cleaning and merging over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import text as t
from docflow.operators import clean
from docflow.operators.stats import size_flags
from docflow.plans.common import query, sql_preview, sql_tokens, sql_trim, sql_words, table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(f"SELECT doc_id, CAST(len({sql_words('text')}) AS INTEGER) AS words FROM documents")
def word_count(spark, sf):
    return docs(spark, sf).select("doc_id", t.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, CAST(length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 AS INTEGER) AS words FROM documents")
def approx_word_count(spark, sf):
    return docs(spark, sf).select("doc_id", t.approx_word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def token_est_chars(spark, sf):
    return docs(spark, sf).select("doc_id", t.token_estimate_chars(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def token_est_words(spark, sf):
    return docs(spark, sf).select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, CAST(floor(len({sql_words('text')}) * 1.3::DOUBLE) AS INTEGER) AS tokens FROM documents")
def token_est_simple(spark, sf):
    return docs(spark, sf).select("doc_id", t.token_estimate_words(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {sql_preview('text')} AS preview FROM documents")
def content_preview(spark, sf):
    return docs(spark, sf).select("doc_id", t.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, substring(text, 1, 1200) AS content FROM documents")
def content_cap(spark, sf):
    return docs(spark, sf).select("doc_id", t.cap(F.col("text"), 1200).alias("content"))


@query(rf"SELECT doc_id, regexp_replace({sql_trim('lower(text)')}, '\s+', ' ', 'g') AS normal FROM documents")
def normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", t.normalize(F.col("text")).alias("normal"))


@query("SELECT doc_id, round(n_chars * 0.15 / 1e6::DOUBLE + doc_id * 0.60 / 1e6::DOUBLE, 9) AS cost FROM documents")
def llm_cost(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(t.llm_cost(F.col("n_chars"), F.col("doc_id")), 9).alias("cost"))


@query("SELECT doc_id, md5(source || '_' || doc_id || '_' || n_chars) AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return docs(spark, sf).select("doc_id", t.fingerprint(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("fingerprint"))


@query("SELECT item_id, md5(text) AS query_hash, md5(text || '||' || item_id) AS pair_hash FROM benchmark")
def query_hashes(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5("text").alias("query_hash"), t.pair_hash(F.col("text"), F.col("item_id").cast("string")).alias("pair_hash"))


NAME = "'reports_2024/q' || (doc_id % 4) || '/annual-report_' || doc_id || (CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.HTML' WHEN 2 THEN '.txt' WHEN 3 THEN '.pdf' ELSE '.yml' END)"


def named(spark, sf):
    d = F.col("doc_id")
    end = F.when(d % 5 == 0, ".md").when(d % 5 == 1, ".HTML").when(d % 5 == 2, ".txt").when(d % 5 == 3, ".pdf").otherwise(".yml")
    return docs(spark, sf).select("doc_id", F.concat(F.lit("reports_2024/q"), (d % 4).cast("string"), F.lit("/annual-report_"), d.cast("string"), end).alias("path"))


@query(f"""WITH p AS (SELECT doc_id, {NAME} AS path FROM documents)
SELECT doc_id, 'annual-report_' || doc_id AS stem, 'Annual Report ' || doc_id AS title, CASE lower(regexp_extract(path, '\\.([^.]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'html' ELSE 'md' END AS source_type FROM p""")
def doc_metadata(spark, sf):
    p = F.col("path")
    return named(spark, sf).select("doc_id", t.stem(p).alias("stem"), t.document_title(p).alias("title"), t.source_type(p).alias("source_type"))


@query(f"SELECT doc_id, {NAME} AS path FROM documents WHERE lower(regexp_extract({NAME}, '(\\.[^.]+)$', 1)) IN ('.txt', '.md', '.html', '.htm') ORDER BY path")
def scan_documents(spark, sf):
    return named(spark, sf).where(t.is_supported(F.col("path"))).orderBy("path")


@query("SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^/]*$', ''), '/'), lambda x: x <> ''), '>') AS folders FROM pages")
def folder_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(t.folder_path(F.regexp_replace("url", "^[a-z]+://", "")), ">").alias("folders"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'mixed' END AS format FROM events UNION ALL SELECT 1000000000 + doc_id, CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'mixed' END FROM documents")
def detect_format(spark, sf):
    e = table(spark, sf, "events").select("event_id", t.detect_format(F.col("props")).alias("format"))
    d = docs(spark, sf).select((F.col("doc_id") + 1000000000).alias("event_id"), t.detect_format(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# T "), F.col("doc_id").cast("string"))).otherwise(F.lit("plain words"))).alias("format"))
    return e.union(d)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, event_type AS kind FROM events")
def flatten_entities(spark, sf):
    p = F.from_json("props", "k long, missing string")
    return table(spark, sf, "events").select("event_id", F.coalesce(p["missing"], F.lit("none")).alias("missing"), F.coalesce(p["k"], F.lit(-1)).alias("k"), F.col("event_type").alias("kind"))


@query("SELECT vec_id, CAST(coalesce(len(CASE WHEN vec_id % 3 > 0 THEN embedding END), 0) AS INTEGER) AS dim FROM embeddings")
def embedding_dim(spark, sf):
    from docflow.functions.vectors import dimension

    return table(spark, sf, "embeddings").select("vec_id", dimension(F.when(F.col("vec_id") % 3 > 0, F.col("embedding"))).alias("dim"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'title' WHEN doc_id % 5 = 2 THEN 'section' WHEN doc_id % 5 >= 3 THEN 'subsection' ELSE 'paragraph' END AS element_type, repeat('#', CAST(doc_id % 5 AS INTEGER)) AS prefix FROM documents")
def classify_level(spark, sf):
    level = (F.col("doc_id") % 5).cast("int")
    return docs(spark, sf).select("doc_id", t.element_type(level).alias("element_type"), t.heading_prefix(level).alias("prefix"))


UNITS = ["Revenue (in millions)", "Growth %", "Net USD", "Shares outstanding", "Fiscal year", "P/E multiple", "Name", "Total (000)"]


@query(f"""SELECT p_partkey, CASE WHEN h LIKE '%thousands%' OR h LIKE '%(000)%' OR h LIKE '%k$%' THEN 'thousands' WHEN h LIKE '%millions%' OR h LIKE '%(000,000)%' OR h LIKE '%m$%' THEN 'millions'
 WHEN h LIKE '%billions%' OR h LIKE '%b$%' THEN 'billions' WHEN h LIKE '%\\%%' ESCAPE '\\' OR h LIKE '%percent%' OR h LIKE '%pct%' THEN 'percent' WHEN h LIKE '%$%' OR h LIKE '%usd%' OR h LIKE '%dollars%' THEN 'dollars'
 WHEN h LIKE '%share%' OR h LIKE '%outstanding%' THEN 'shares' WHEN h LIKE '%year%' OR h LIKE '%yr%' OR h LIKE '%annual%' THEN 'years' WHEN h LIKE '%ratio%' OR h LIKE '%multiple%' OR h LIKE '%x%' THEN 'ratio' END AS unit
 FROM (SELECT p_partkey, lower({UNITS!r}[1 + p_partkey % {len(UNITS)}]) AS h FROM part)""")
def column_units(spark, sf):
    header = F.element_at(F.array(*map(F.lit, UNITS)), (1 + F.col("p_partkey") % len(UNITS)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", t.column_unit(header).alias("unit"))


@query(f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'The following table shows ' || text ELSE text END AS caption FROM documents),
s AS (SELECT doc_id, CASE WHEN lower({sql_trim('caption')}) LIKE 'the following table%' THEN substring({sql_trim('caption')}, 21) ELSE {sql_trim('caption')} END AS s FROM c)
SELECT doc_id, CASE WHEN length(s) > 100 THEN substring(s, 1, 100) || '...' ELSE s END AS summary FROM s""")
def fallback_summary(spark, sf):
    caption = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("The following table shows "), F.col("text"))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", t.fallback_summary(caption).alias("summary"))


@query(f"SELECT doc_id FROM documents WHERE length({sql_trim('text')}) > 0")
def nonblank_docs(spark, sf):
    return docs(spark, sf).where(F.length(F.regexp_replace(F.col("text"), r"^\s+|\s+$", "")) > 0).select("doc_id")


DIRTY = r"""'Skip to main content' || chr(10) || 'Home > Reports' || chr(10) || '***' || chr(10) || '----------' || chr(10) || text || '   ' || chr(10) || '.....' || chr(10) || '_____' || chr(10) || chr(10) || chr(10) || 'GLYPH<c=3>end ' || chr(7)"""
CLEAN = rf"""WITH d AS (SELECT doc_id, regexp_replace({DIRTY}, '[\x00-\x08\x0B\x0C\x0E-\x1F]|GLYPH<[^>]*>', ' ', 'g') AS t FROM documents),
l AS (SELECT doc_id, list_transform(list_filter(string_split(t, chr(10)), lambda x: {sql_trim('x')} = '' OR NOT ((length({sql_trim('x')}) <= 30 AND regexp_matches({sql_trim('x')}, '(?i)skip\s+to\s+(main\s+)?content|skip\s+to\s+homepage|toggle\s+navigation|breadcrumb|^\s*(home\s*[>›»]|[>›»])\s*'))
 OR regexp_matches(x, '^\s*[-•·▪▫◦‣⁃]+\s*$|^\s*[─━═_]{{3,}}\s*$|^\s*\.{{3,}}\s*$|^\s*[^\w\s]{{1,2}}\s*$'))), lambda x: CASE WHEN {sql_trim('x')} = '' THEN '' ELSE x END) AS ls FROM d),
j AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '[ \t]{{2,}}', ' ', 'g'), '(?m)[ \t]+$', '', 'g') AS t FROM l)
SELECT doc_id, {sql_trim(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")} AS content FROM j"""


@query(CLEAN)
def clean_text(spark, sf):
    dirty = F.concat(F.lit("Skip to main content\nHome > Reports\n***\n----------\n"), F.col("text"), F.lit("   \n.....\n_____\n\n\nGLYPH<c=3>end \x07"))
    return docs(spark, sf).select("doc_id", clean.clean_text(dirty).alias("content"))


W1, W2 = f"list_distinct({sql_words('lower(a.text)')})", f"list_distinct({sql_words('lower(b.text)')})"


@query(f"SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat({W1}, {W2}))) = 0 THEN 0 ELSE len(list_intersect({W1}, {W2})) / len(list_distinct(list_concat({W1}, {W2}))) END, 6) AS similarity FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def jaccard_pairs(spark, sf):
    a = docs(spark, sf)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return a.join(b, "doc_id").select("doc_id", F.round(t.jaccard(F.col("text"), F.col("next_text")), 6).alias("similarity"))


# Whole documents as chunks: groups of eight documents stand for the chunks of one.
CHUNKS = "SELECT doc_id // 8 AS doc_id, doc_id % 8 AS chunk_index, CASE doc_id % 4 WHEN 0 THEN ['A'] WHEN 1 THEN ['A', 'B'] WHEN 2 THEN ['C', 'D', 'E'] ELSE [] END AS section_path, text AS content FROM documents"


def chunks(spark, sf):
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    path = F.when(d % 4 == 0, F.array(F.lit("A"))).when(d % 4 == 1, F.array(F.lit("A"), F.lit("B"))).when(d % 4 == 2, F.array(F.lit("C"), F.lit("D"), F.lit("E"))).otherwise(none)
    return docs(spark, sf).select(F.floor(d / 8).alias("doc_id"), (d % 8).alias("chunk_index"), path.alias("section_path"), F.col("text").alias("content"))


C1, C2 = f"list_distinct({sql_words('lower(content)')})", f"list_distinct({sql_words('lower(next_content)')})"
PAIRS = f"""WITH c AS ({CHUNKS}), n AS (SELECT *, lead(section_path) OVER w AS next_path, lead(content) OVER w AS next_content FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
p AS (SELECT *, len({C1}) > 0 AND len(list_intersect({C1}, {C2})) / len(list_distinct(list_concat({C1}, {C2}))) > 0.6 AS alike,
 section_path = next_path OR next_path[1:len(section_path)] = section_path OR section_path[1:len(next_path)] = next_path
 OR (len(section_path) = len(next_path) AND len(list_filter(list_zip(section_path, next_path), lambda z: z[1] <> z[2])) <= 1) AS related FROM n WHERE next_content IS NOT NULL)"""


@query(PAIRS + " SELECT doc_id, chunk_index, (related OR alike) AS mergeable FROM p")
def mergeable_pairs(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    n = chunks(spark, sf).withColumn("np", F.lead("section_path").over(w)).withColumn("nc", F.lead("content").over(w)).where("nc is not null")
    return n.select("doc_id", "chunk_index", clean.mergeable(F.col("section_path"), F.col("np"), F.col("content"), F.col("nc")).alias("mergeable"))


MERGE = PAIRS.replace("FROM n WHERE next_content IS NOT NULL)", "FROM n)") + f""",
f AS (SELECT *, coalesce(next_content IS NOT NULL AND len({sql_words('content')}) < 50 AND (related OR alike), false) AS flag FROM p),
g AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) - CASE WHEN flag THEN 0 ELSE 1 END AS island FROM f),
h AS (SELECT *, flag AND row_number() OVER (PARTITION BY doc_id, island ORDER BY chunk_index) % 2 = 1 AS merges FROM g),
i AS (SELECT *, coalesce(lag(merges) OVER (PARTITION BY doc_id ORDER BY chunk_index), false) AS gone FROM h)
SELECT doc_id, chunk_index, array_to_string(CASE WHEN merges AND len(next_path) > len(section_path) THEN next_path ELSE section_path END, '/') AS path,
 CASE WHEN merges THEN content || chr(10) || chr(10) || next_content ELSE content END AS content, merges FROM i WHERE NOT gone"""


@query(MERGE)
def merge_small(spark, sf):
    return clean.merge_small(chunks(spark, sf)).select("doc_id", "chunk_index", F.array_join("section_path", "/").alias("path"), "content", "merges")


@query(f"""WITH w AS (SELECT len({sql_words('text')}) AS v FROM documents) SELECT count(*) FILTER (v < 50) AS very_short, count(*) FILTER (v > 500) AS very_long, count(*) FILTER (v BETWEEN 100 AND 300) AS optimal,
 round(100.0::DOUBLE * count_if(v < 50) / count(*), 6) AS short_pct, round(100.0::DOUBLE * count_if(v > 500) / count(*), 6) AS long_pct, round(100.0::DOUBLE * count_if(v BETWEEN 100 AND 300) / count(*), 6) AS optimal_pct FROM w""")
def chunk_size_flags(spark, sf):
    return size_flags(docs(spark, sf), t.word_count(F.col("text")))


@query("SELECT conv_id, turn, 'System: ' || role || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || turn || chr(10) || chr(10) || 'Answer:' AS prompt FROM conversations")
def prompts(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", t.prompt(F.concat(F.lit("System: "), "role"), F.col("text"), F.col("turn").cast("string")).alias("prompt"))
