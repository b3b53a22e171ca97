"""Headings, contents, sentences, chunks, tables, and chunks joined to elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import text as t
from docflow.operators import chunk, enrich, structure, tables
from docflow.plans.common import MARKDOWN_SQL, markdown, query, sql_tokens, sql_trim, sql_words, table


def docs(spark, sf):
    return table(spark, sf, "documents")


LINES = f"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_number FROM {MARKDOWN_SQL})"
HEADS = f"{LINES}, h AS (SELECT doc_id, line_number, CAST(length(regexp_extract({sql_trim('line')}, '^(#+)', 1)) AS INTEGER) AS level, {sql_trim(f'''regexp_replace({sql_trim('line')}, '^#+', '')''')} AS heading FROM l WHERE {sql_trim('line')} LIKE '#%')"


def heads(spark, sf):
    return structure.headings(markdown(docs(spark, sf)))


@query(f"WITH {HEADS} SELECT * FROM h WHERE heading <> ''")
def headings(spark, sf):
    return heads(spark, sf)


@query(f"""WITH {HEADS}, c AS (SELECT doc_id, line_number AS chunk_id, line_number FROM l), f AS (SELECT doc_id, arg_min(struct_pack(level, heading), line_number) AS first FROM h GROUP BY 1)
SELECT c.doc_id, c.chunk_id, c.line_number, coalesce(h.level, f.first.level) AS level, coalesce(h.heading, f.first.heading) AS heading FROM c ASOF LEFT JOIN h ON c.doc_id = h.doc_id AND c.line_number >= h.line_number LEFT JOIN f ON f.doc_id = c.doc_id""")
def heading_asof(spark, sf):
    chunks = structure.lines(markdown(docs(spark, sf))).select("doc_id", F.col("line_number").alias("chunk_id"), "line_number")
    return structure.heading_asof(chunks, heads(spark, sf))


@query(f"""WITH {HEADS}, up AS (SELECT a.*, (SELECT max(b.line_number) FROM h b WHERE b.doc_id = a.doc_id AND b.line_number < a.line_number AND b.level < a.level) AS parent FROM h a)
SELECT a.doc_id, a.line_number, a.level, a.heading, coalesce(c.heading || ' > ', '') || coalesce(b.heading || ' > ', '') || a.heading AS path
FROM up a LEFT JOIN up b ON b.doc_id = a.doc_id AND b.line_number = a.parent LEFT JOIN up c ON c.doc_id = a.doc_id AND c.line_number = b.parent""")
def heading_path(spark, sf):
    return structure.heading_paths(heads(spark, sf)).drop("levels").withColumn("path", F.array_join("path", " > "))


PROBE = f"CASE WHEN length(array_to_string({sql_words('content')}[1:5], ' ')) < 10 THEN substring(content, 1, 50) ELSE array_to_string({sql_words('content')}[1:5], ' ') END"


@query(f"""WITH {HEADS}, up AS (SELECT a.*, (SELECT max(b.line_number) FROM h b WHERE b.doc_id = a.doc_id AND b.line_number < a.line_number AND b.level < a.level) AS parent FROM h a),
paths AS (SELECT a.doc_id, a.line_number, list_filter([c.heading, b.heading, a.heading], lambda x: x IS NOT NULL) AS path FROM up a LEFT JOIN up b ON b.doc_id = a.doc_id AND b.line_number = a.parent LEFT JOIN up c ON c.doc_id = a.doc_id AND c.line_number = b.parent),
p AS (SELECT l.doc_id, l.line_number AS chunk_id, line AS content, text FROM l JOIN {MARKDOWN_SQL} d ON d.doc_id = l.doc_id WHERE {sql_trim('line')} <> ''), q AS (SELECT *, {PROBE} AS probe FROM p),
f AS (SELECT *, coalesce(nullif(instr(text, probe), 0), nullif(instr(array_to_string({sql_words('text')}, ' '), array_to_string({sql_words('probe')}, ' ')), 0)) AS pos FROM q),
g AS (SELECT doc_id, chunk_id, coalesce(length(left(text, pos - 1)) - length(replace(left(text, pos - 1), chr(10), '')), 2147483647) AS line_number FROM f), first AS (SELECT doc_id, arg_min(path, line_number) AS path FROM paths GROUP BY 1)
SELECT g.doc_id, g.chunk_id, array_to_string(coalesce(paths.path, first.path), ' > ') AS path FROM g ASOF LEFT JOIN paths ON g.doc_id = paths.doc_id AND g.line_number >= paths.line_number LEFT JOIN first ON first.doc_id = g.doc_id""")
def chunk_headings(spark, sf):
    """Each line of a document as a chunk, found by its first words."""
    d = markdown(docs(spark, sf))
    lines = structure.lines(d).where(structure.trimmed(F.col("line")) != "").select("doc_id", F.col("line_number").alias("chunk_id"), F.col("line").alias("content"))
    return structure.chunk_headings(lines, d).select("doc_id", "chunk_id", F.array_join("path", " > ").alias("path"))


@query()
def chunk_under_headings(spark, sf):
    return chunk.chunk_under_headings(markdown(docs(spark, sf)))


@query(f"WITH {HEADS} SELECT doc_id, line_number, CASE WHEN length(heading || ' GLYPH') > 50 THEN substring(heading || ' GLYPH', 1, 50) || '...' ELSE heading || ' GLYPH' END AS heading FROM h WHERE length(heading || ' GLYPH') > 10")
def corrupt_headings(spark, sf):
    h = heads(spark, sf).withColumn("kept", structure.truncate_corrupt(F.array(F.concat("heading", F.lit(" GLYPH")))))
    return h.where(F.size("kept") > 0).select("doc_id", "line_number", F.get("kept", 0).alias("heading"))


S = sql_trim("line")
PAGE = rf"(regexp_matches({S}, '^(.+?)\.{{2,}}\s*(\d+)$') OR regexp_matches({S}, '^(.+?)\s{{3,}}(\d+)$') OR regexp_matches({S}, '^\|\s*(.+?)\s*\|.*?\|\s*(\d+)\s*\|?$'))"
DENSITY = f"""WITH {LINES},
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, CAST({S} <> '' AS INTEGER) AS filled, CAST({S} <> '' AND {PAGE} AS INTEGER) AS page,
 CAST({S} <> '' AND NOT {PAGE} AND regexp_matches({S}, '(?i)^[|\\-*•]|\\b(?:item|part|section|chapter)\\b|\\.{{2,}}|:.*\\d+$') AS INTEGER) AS structure FROM l WHERE line_number < 1000),
w AS (SELECT *, least(15, greatest(5, n // 150)) AS w FROM m),
s AS (SELECT a.doc_id, a.line_number AS start_line, a.w AS window_lines, sum(b.page) AS p, sum(b.structure) AS s, sum(b.filled) AS f FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.line_number >= a.line_number AND b.line_number < a.line_number + a.w
 WHERE a.line_number < a.n - a.w AND a.line_number % greatest(2, a.w // 2) = 0 GROUP BY ALL)
SELECT doc_id, start_line, CAST(window_lines AS INTEGER) AS window_lines, round(CASE WHEN f > 0 THEN p / f * 0.7::DOUBLE + s / f * 0.3::DOUBLE ELSE 0 END, 6) AS score FROM s WHERE round(CASE WHEN f > 0 THEN p / f * 0.7::DOUBLE + s / f * 0.3::DOUBLE ELSE 0 END, 6) > 0.15"""


@query(DENSITY)
def toc_density(spark, sf):
    return structure.dense_windows(structure.marked_lines(markdown(docs(spark, sf))))


@query()
def toc_candidates(spark, sf):
    return structure.toc_candidates(markdown(docs(spark, sf)))


INTERVALS = "SELECT doc_id // 6 AS doc_id, CAST(doc_id * 7 % 40 AS INTEGER) AS start_line, CAST(doc_id * 7 % 40 + 5 + doc_id % 11 AS INTEGER) AS end_line, round((doc_id * 37 % 100) / 100, 6) AS score, 'made' AS reason FROM documents"


@query(f"""WITH c AS ({INTERVALS}), one AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start_line, end_line, reason) AS INTEGER) AS pick FROM c) WHERE pick = 1),
two AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.score DESC, c.start_line, c.end_line, c.reason) AS pick FROM c JOIN one o ON o.doc_id = c.doc_id AND (c.start_line >= o.end_line OR c.end_line <= o.start_line)) WHERE pick = 1)
SELECT * FROM (SELECT * FROM one UNION ALL SELECT * REPLACE (2 AS pick) FROM two) WHERE score > 0.5""")
def toc_select(spark, sf):
    d = F.col("doc_id")
    made = docs(spark, sf).select(F.floor(d / 6).alias("doc_id"), (d * 7 % 40).cast("int").alias("start_line"), (d * 7 % 40 + 5 + d % 11).cast("int").alias("end_line"), F.round(d * 37 % 100 / 100, 6).alias("score"), F.lit("made").alias("reason"))
    return structure.select_candidates(made)


ENTRY = rf"""WITH {LINES}, e AS (SELECT doc_id, line_number, line, {S} AS s FROM l),
p AS (SELECT *, CASE WHEN regexp_matches(s, '^(.+?)\.{{2,}}\s*(\d+)$') THEN regexp_extract(s, '^(.+?)\.{{2,}}\s*(\d+)$', 1) WHEN regexp_matches(s, '^(.+?)\s{{3,}}(\d+)$') THEN regexp_extract(s, '^(.+?)\s{{3,}}(\d+)$', 1)
 WHEN regexp_matches(s, '^\|\s*(.+?)\s*\|.*?\|\s*(\d+)\s*\|?$') THEN regexp_extract(s, '^\|\s*(.+?)\s*\|.*?\|\s*(\d+)\s*\|?$', 1) END AS title,
 CASE WHEN regexp_matches(s, '^(.+?)\.{{2,}}\s*(\d+)$') THEN regexp_extract(s, '^(.+?)\.{{2,}}\s*(\d+)$', 2) WHEN regexp_matches(s, '^(.+?)\s{{3,}}(\d+)$') THEN regexp_extract(s, '^(.+?)\s{{3,}}(\d+)$', 2)
 WHEN regexp_matches(s, '^\|\s*(.+?)\s*\|.*?\|\s*(\d+)\s*\|?$') THEN regexp_extract(s, '^\|\s*(.+?)\s*\|.*?\|\s*(\d+)\s*\|?$', 2) END AS page,
 regexp_extract(s, '^\s*(\d+)\.\s+(.+)$', 2) AS numbered, regexp_extract(s, '^\s*(\d+\.\d+)\.\s+(.+)$', 2) AS double FROM e)
SELECT doc_id, line_number, CAST(CASE WHEN title IS NULL THEN CASE WHEN numbered <> '' THEN 1 ELSE 2 END
 WHEN regexp_matches(lower(title), '^(chapter|part|section|item)') THEN 1 WHEN regexp_matches(lower(title), 'subsection|appendix|annex') THEN 2 ELSE least(6, length(regexp_extract(line, '^(\s*)', 1)) // 4 + 1) END AS INTEGER) AS level,
 coalesce({sql_trim('title')}, CASE WHEN numbered <> '' THEN {sql_trim('numbered')} ELSE {sql_trim('double')} END) AS title, CAST(page AS INTEGER) AS page, CAST(CASE WHEN title IS NULL THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence
FROM p WHERE title IS NOT NULL OR numbered <> '' OR double <> ''"""


@query(ENTRY)
def toc_entries(spark, sf):
    return structure.toc_entries(markdown(docs(spark, sf)))


@query(f"""WITH {HEADS} SELECT doc_id, count(*) FILTER (level = 1) AS titles, count(*) FILTER (level = 2) AS sections, count(*) FILTER (level >= 3) AS subsections, array_to_string(list_sort(list_distinct(list(level))), ',') AS levels FROM h GROUP BY 1""")
def structure_info(spark, sf):
    level = F.col("level")
    return heads(spark, sf).groupBy("doc_id").agg(F.count_if(level == 1).alias("titles"), F.count_if(level == 2).alias("sections"), F.count_if(level >= 3).alias("subsections"), F.array_join(F.sort_array(F.collect_set("level")), ",").alias("levels"))


SENTENCES = rf"""WITH l AS (SELECT doc_id, {sql_trim('u')} AS line, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {MARKDOWN_SQL}) WHERE {sql_trim('u')} <> ''),
c AS (SELECT *, line LIKE '#%' AS hd, CASE WHEN line LIKE '#%' OR coalesce(lag(line) OVER w LIKE '#%', true) THEN 1 ELSE 0 END AS change FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT *, CAST(sum(change) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM c),
g AS (SELECT doc_id, block, hd, string_agg(line, ' ' ORDER BY n) AS body FROM b GROUP BY ALL),
s AS (SELECT doc_id, block, CASE WHEN hd THEN [body] ELSE list_filter(string_split(regexp_replace(body, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {sql_trim('x')} <> '') END AS parts FROM g)
SELECT doc_id, block, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position, unnest(parts) AS sentence FROM s"""


@query(SENTENCES)
def sentences(spark, sf):
    return chunk.sentences(markdown(docs(spark, sf)))


@query(f"SELECT doc_id, CASE WHEN length(text) - length(replace(replace(replace(text, '.', ''), '!', ''), '?', '')) <= 3 OR len({sql_words('text')}) < 100 THEN 512 ELSE 450 END AS max_tokens FROM documents")
def chunk_budget(spark, sf):
    return docs(spark, sf).select("doc_id", chunk.budget(F.col("text")).alias("max_tokens"))


@query()
def chunk_greedy(spark, sf):
    return chunk.chunk_documents(docs(spark, sf))


@query()
def force_split(spark, sf):
    """T9 on whole texts: what the packer does with an oversized sentence."""
    return chunk.force_split_documents(docs(spark, sf))


@query()
def chunk_elements(spark, sf):
    lines = structure.lines(docs(spark, sf)).where(F.length(F.trim("line")) > 0)
    return chunk.chunk_elements(lines.select("doc_id", F.col("line_number").alias("idx"), F.col("line").alias("text"), t.token_estimate(F.col("line")).alias("tokens")))


TAIL = f"""WITH s AS (SELECT doc_id, n, {sql_tokens('x')} AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS n FROM documents)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS behind, sum(tokens) OVER (PARTITION BY doc_id) AS total FROM s)
SELECT doc_id, n, tokens FROM r WHERE behind <= CAST(floor(total * 0.2::DOUBLE) AS BIGINT)"""


@query(TAIL)
def overlap_suffix(spark, sf):
    """T5 as a window: a running sum from the end."""
    from pyspark.sql import Window

    s = structure.lines(docs(spark, sf)).select("doc_id", F.col("line_number").alias("n"), t.token_estimate(F.col("line")).alias("tokens"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("tokens").over(Window.partitionBy("doc_id"))
    return s.withColumn("behind", F.sum("tokens").over(w)).withColumn("most", F.floor(total * F.lit(0.2))).where("behind <= most").select("doc_id", "n", "tokens")


@query("""WITH r AS (SELECT n.n_regionkey AS table_id, n.n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name || '|', '|', '\\|') || ' | ' || r_name || ' |' AS line FROM nation n JOIN region ON r_regionkey = n_regionkey)
SELECT table_id, '| key | name | region |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n_nationkey) AS markdown FROM r GROUP BY 1""")
def table_to_markdown(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_regionkey").alias("table_id"), "n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit("|")), "r_name").alias("cells"))
    return tables.rows_to_markdown(rows, ["key", "name", "region"], "n_nationkey")


@query()
def table_pack(spark, sf):
    """Customers of each nation as tables in parts."""
    c = table(spark, sf, "customer")
    line = tables.render_row(F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"))
    body = c.select(F.col("c_nationkey").alias("table_id"), F.col("c_custkey").alias("row_index"), line.alias("line"))
    header = F.concat(tables.render_row(F.array(F.lit("key"), F.lit("name"), F.lit("segment"))), F.lit("\n"), tables.separator(F.array(F.lit(1), F.lit(2), F.lit(3))))
    head = c.select(F.col("c_nationkey").alias("table_id")).distinct().select("table_id", F.lit(-1).cast("long").alias("row_index"), header.alias("line"))
    return tables.pack_rows(body.union(head).withColumn("tokens", tables.tokens_of(F.col("line"))))


def elements(spark, sf):
    """All lines of the documents' texts stand for layout elements of groups of documents, numbered from 0 in each group."""
    from pyspark.sql import Window

    lines = structure.lines(docs(spark, sf)).withColumn("group", F.col("doc_id") % 97)
    idx = F.row_number().over(Window.partitionBy("group").orderBy("doc_id", "line_number")) - 1
    return lines.select(F.col("group").alias("doc_id"), idx.alias("idx"), F.col("line").alias("text"), (F.col("line_number") % 7).alias("page"))


ELEMENTS = "SELECT doc_id % 97 AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id, n) - 1 AS INTEGER) AS idx, x AS text, CAST(n % 7 AS INTEGER) AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"


def parts(spark, sf):
    d = docs(spark, sf)
    return d.select(F.col("doc_id").cast("string").alias("chunk_id"), (F.col("doc_id") % 97).alias("doc_id"), F.when((F.col("doc_id") % 3 == 0) & (F.col("lang") == "en"), t.upper(F.get(F.split("text", "\n"), 0))).otherwise(F.col("text")).alias("content"), (F.col("doc_id") % 10).cast("int").alias("page"))


PARTS = "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id % 97 AS doc_id, CASE WHEN doc_id % 3 = 0 AND lang = 'en' THEN upper(string_split(text, chr(10))[1]) ELSE text END AS content, CAST(doc_id % 10 AS INTEGER) AS page FROM documents"


def norm(x):
    return rf"regexp_replace({sql_trim(f'lower({x})')}, '\s+', ' ', 'g')"


MATCH = f"""WITH e AS MATERIALIZED (SELECT *, {norm('text')} AS en FROM ({ELEMENTS})), c AS MATERIALIZED (SELECT *, {norm('content')} AS cn FROM ({PARTS})),
exact AS (SELECT chunk_id, max(idx) AS idx, 'content_exact' AS method, 1.0::DOUBLE AS confidence FROM c JOIN e ON e.doc_id = c.doc_id AND en = cn GROUP BY 1),
holds AS (SELECT chunk_id, min(idx) AS idx, 'content_contains' AS method, 0.9::DOUBLE AS confidence FROM c JOIN e ON e.doc_id = c.doc_id AND contains(cn, en) AND length(en) BETWEEN 10 AND greatest(length(cn) // 2, 20) GROUP BY 1),
near AS (SELECT chunk_id, min(struct_pack(idx, same := c.page = e.page)) AS m FROM c JOIN e ON e.doc_id = c.doc_id AND abs(c.page - e.page) <= 2 AND idx < 20 GROUP BY 1),
page AS (SELECT chunk_id, m.idx AS idx, 'position' AS method, CASE WHEN m.same THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM near) """


@query(f"SELECT doc_id, idx, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM ({ELEMENTS}) WHERE length(trim(text)) > 5) WHERE n <= 3000")
def usable_elements(spark, sf):
    return enrich.usable_elements(elements(spark, sf)).select("doc_id", "idx", "text")


@query(MATCH + "SELECT * FROM exact")
def match_exact(spark, sf):
    return enrich.match_exact(parts(spark, sf), elements(spark, sf)).select("chunk_id", "idx", "method", "confidence")


@query(MATCH + "SELECT * FROM holds")
def match_contains(spark, sf):
    return enrich.match_contains(parts(spark, sf), elements(spark, sf))


@query(MATCH.replace("near AS (SELECT chunk_id, min(struct_pack(idx, same := c.page = e.page)) AS m", "near AS (SELECT chunk_id, arg_min(struct_pack(idx, same := c.page = e.page), idx) AS m") + "SELECT * FROM page")
def match_page(spark, sf):
    return enrich.match_page(parts(spark, sf), elements(spark, sf))


@query()
def match_fuzzy(spark, sf):
    return enrich.match_fuzzy(parts(spark, sf), elements(spark, sf))


@query(MATCH.replace("near AS (SELECT chunk_id, min(struct_pack(idx, same := c.page = e.page)) AS m", "near AS (SELECT chunk_id, arg_min(struct_pack(idx, same := c.page = e.page), idx) AS m") + """SELECT chunk_id, idx, method, confidence FROM c LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC) AS n FROM (SELECT * FROM exact UNION ALL SELECT * FROM holds UNION ALL SELECT * FROM page)) m USING (chunk_id) WHERE coalesce(n, 1) = 1""")
def match_priority(spark, sf):
    """J5 without the fuzzy step, which SQL cannot express."""
    return enrich.match_priority(parts(spark, sf), elements(spark, sf), fuzzy=False).select("chunk_id", "idx", "method", "confidence")
