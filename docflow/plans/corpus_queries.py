"""Duplicates, the store, statistics, history, incremental ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.config import HISTORY_LENGTH
from docflow.functions import text as t
from docflow.operators import context, maintenance, search, stats
from docflow.plans.common import query, sql_preview, sql_tokens, sql_words, table
from docflow.sources import files, sinks


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)")
def dup_analysis(spark, sf):
    return maintenance.duplicate_summary(docs(spark, sf).select(F.md5("text").alias("k")), "k")


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dups(spark, sf):
    return maintenance.content_groups(docs(spark, sf))


@query("SELECT doc_id, md5(text) AS k FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, sf):
    return search.keep_first(docs(spark, sf).select("doc_id", F.md5("text").alias("k")), ["k"], [F.col("doc_id")])


@query("SELECT doc_id, md5(text) AS k FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def dedup_dry_run(spark, sf):
    return maintenance.remove_duplicates(docs(spark, sf).select("doc_id", F.md5("text").alias("k")), ["k"], [F.col("doc_id")], dry_run=True)


@query("SELECT doc_id, md5(source || '_' || doc_id || '_' || n_chars) AS fingerprint FROM documents WHERE md5(source || '_' || doc_id || '_' || n_chars) NOT IN (SELECT md5(source || '_' || doc_id || '_' || n_chars) FROM documents WHERE lang = 'en')")
def incremental_files(spark, sf):
    f = docs(spark, sf).select("doc_id", "lang", t.fingerprint(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("fingerprint"))
    return maintenance.unprocessed(f, f.where("lang = 'en'")).select("doc_id", "fingerprint")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 > 0)")
def missing_embedding(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 3 > 0, F.col("embedding")).alias("embedding"))
    return maintenance.missing(docs(spark, sf).select("doc_id"), e, "doc_id")


def stored(spark, sf):
    d = F.col("doc_id")
    return docs(spark, sf).select(
        F.concat(F.lit("c"), d.cast("string")).alias("chunk_id"), F.col("source").alias("doc_id"), F.col("text").alias("content"), F.when(d % 2 == 0, t.word_count(F.col("text"))).alias("word_count"),
        F.when(d % 3 > 0, F.array(F.lit("A"), F.col("lang"))).alias("section_path"), F.when(d % 4 == 0, "table").alias("chunk_type"), F.lit(None).cast("string").alias("product_version"),
        F.when(d % 5 == 0, d.cast("int")).alias("page"), F.lit(None).cast("array<string>").alias("dates"), F.array("lang").alias("regions"),
    )


@query(f"""SELECT 'c' || doc_id AS chunk_id, source AS doc_id, substring(text, 1, 65535) AS content, CAST(CASE WHEN doc_id % 2 = 0 THEN len({sql_words('text')}) ELSE 0 END AS INTEGER) AS word_count, CASE WHEN doc_id % 3 > 0 THEN '["A","' || lang || '"]' ELSE '[]' END AS section_path,
 CASE WHEN doc_id % 4 = 0 THEN 'table' ELSE 'text' END AS chunk_type, 'v1' AS product_version, source, CAST(CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE 0 END AS INTEGER) AS page, '[]' AS dates, '["' || lang || '"]' AS regions FROM documents""")
def store_rows(spark, sf):
    return sinks.store_rows(stored(spark, sf))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def scan_page(spark, sf):
    return files.page_of(docs(spark, sf), "doc_id", 100, 50, ["doc_id", "source"])


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 20")
def sample_chunks(spark, sf):
    return files.sample(docs(spark, sf), "doc_id", 20).select("doc_id", "source")


@query("SELECT count(*) AS row_count, count(DISTINCT label) AS labels, CAST(min(len(embedding)) AS INTEGER) AS dim FROM embeddings")
def collection_stats(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count("*").alias("row_count"), F.countDistinct("label").alias("labels"), F.min(F.size("embedding")).alias("dim"))


@query("SELECT count(*) AS total, count(*) FILTER (quality IS NOT NULL) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (lang = 'en') AS english FROM documents LEFT JOIN labels USING (doc_id)")
def dump_counts(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("quality").isNotNull()).alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("lang") == "en").alias("english"))


@query(f"SELECT count(*) AS n_chunks, round(avg(len({sql_words('text')})), 6) AS mean_words, CAST(sum({sql_tokens('text')}) AS BIGINT) AS total_tokens, CAST(max(length(text)) AS INTEGER) AS longest FROM documents")
def processing_summary(spark, sf):
    return sinks.summary(docs(spark, sf), F.col("text"), t.word_count(F.col("text")), t.token_estimate(F.col("text")))


@query(f"SELECT doc_id, lang, {sql_preview('text')} AS content_preview FROM documents")
def export_sample(spark, sf):
    return sinks.export_sample(docs(spark, sf).select("doc_id", "lang", F.col("text").alias("content")), True).select("doc_id", "lang", "content_preview")


@query(f"""WITH w AS (SELECT CAST(len({sql_words('text')}) AS DOUBLE) AS v FROM documents) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max,
 round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM w""")
def chunk_size_stats(spark, sf):
    return stats.size_stats(docs(spark, sf), t.word_count(F.col("text")))


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, kind")
def counts_by_type(spark, sf):
    return stats.counts_by(docs(spark, sf), F.col("lang"), "kind")


@query("SELECT source AS doc, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, doc LIMIT 10")
def counts_by_doc(spark, sf):
    return stats.counts_by(docs(spark, sf), F.col("source"), "doc", 10)


@query("SELECT s AS section, count(*) AS n FROM (SELECT unnest([lang, source]) AS s FROM documents) GROUP BY 1 ORDER BY n DESC, section LIMIT 5")
def top_sections(spark, sf):
    e = docs(spark, sf).select(F.explode(F.array("lang", "source")).alias("s"))
    return stats.counts_by(e, F.col("s"), "section", 5)


E = "embedding::DOUBLE[]"
FEATURES = f"SELECT vec_id, label, round(sqrt(list_dot_product({E}, {E})), 6) AS norm, round(list_sum({E}) / len(embedding), 6) AS mean, round(sqrt(list_sum(list_transform({E}, lambda x: (x - list_sum({E}) / len(embedding)) ^ 2)) / len(embedding)), 6) AS std, round(list_min({E}), 6) AS min_value, round(list_max({E}), 6) AS max_value, round(list_max({E}) - list_min({E}), 6) AS value_range FROM embeddings"


@query(FEATURES)
def embedding_features(spark, sf):
    return stats.embedding_features(table(spark, sf, "embeddings"))


@query(f"""SELECT count(*) AS n, round(avg(sqrt(list_dot_product({E}, {E}))), 6) AS mean_norm, round(stddev_pop(sqrt(list_dot_product({E}, {E}))), 6) AS std_norm, round(min(list_min({E})), 6) AS min_value, round(max(list_max({E})), 6) AS max_value,
 round(100.0::DOUBLE * sum(len(list_filter(embedding, lambda x: abs(x) < 1e-6))) / sum(len(embedding)), 6) AS sparsity_pct, CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes FROM embeddings""")
def embedding_stats(spark, sf):
    return stats.embedding_stats(table(spark, sf, "embeddings"))


@query("SELECT dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def dim_stats(spark, sf):
    return stats.dimension_stats(table(spark, sf, "embeddings"))


NAMES = ["mean", "std", "min_value", "max_value", "value_range", "label"]


@query(f"WITH f AS ({FEATURES}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM f" for a in NAMES for b in NAMES))
def corr_matrix(spark, sf):
    return stats.correlations(stats.embedding_features(table(spark, sf, "embeddings")), NAMES)


SCALED = "list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7))"
PROPERTY = f"""WITH v AS (SELECT vec_id, {SCALED} AS e FROM embeddings WHERE len(embedding) > 0),
f AS (SELECT len({sql_words('text')}) AS word_count, length(text) AS content_length, len(string_split(source, 'e')) AS section_depth, sqrt(list_dot_product(e, e)) AS norm, list_sum(e) / len(e) AS mean,
 sqrt(list_sum(list_transform(e, lambda x: (x - list_sum(e) / len(e)) ^ 2)) / len(e)) AS std, list_max(e) - list_min(e) AS value_range, list_max(e) AS max_value, list_min(e) AS min_value FROM v JOIN documents ON doc_id = vec_id) """


@query(PROPERTY + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 4) END AS r FROM f" for a in stats.PROPERTIES for b in stats.PROPERTIES))
def property_correlations(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)))
    chunks = docs(spark, sf).select("doc_id", F.col("text").alias("content"), F.split("source", "e").alias("section_path"))
    return stats.property_correlations(e.join(chunks, F.col("doc_id") == F.col("vec_id")))


@query(f"""SELECT count(*) AS chunks, count(*) FILTER (quality = 1) AS matched, count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL) AS extended, CAST(sum(len({sql_words('text')}) + 1) AS BIGINT) AS entities FROM documents LEFT JOIN labels USING (doc_id)""")
def enrichment_counts(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    chunks = docs(spark, sf).join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", t.words(F.col("text")).alias("words"), F.array("lang").alias("langs"))
    return stats.enrichment_counts(chunks, F.col("quality") == 1, ["doc_id", "words", "langs"], ["words", "langs"])


@query("SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def result_duplicates(spark, sf):
    """What a list of results holds more than once."""
    return maintenance.duplicate_counts(docs(spark, sf), "lang", "source")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS merged FROM events GROUP BY 1")
def last_wins(spark, sf):
    """U8: of the rows of each key the values of the last."""
    e = table(spark, sf, "events")
    return maintenance.last_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "merged")


@query(f"WITH f AS ({FEATURES}) SELECT label AS depth, round(avg(max_value), 3) AS mean, round(stddev_samp(max_value), 3) AS std, count(*) AS n FROM f GROUP BY 1")
def depth_stats(spark, sf):
    f = stats.embedding_features(table(spark, sf, "embeddings"))
    return f.groupBy(F.col("label").alias("depth")).agg(F.round(F.avg("max_value"), 3).alias("mean"), F.round(F.stddev_samp("max_value"), 3).alias("std"), F.count("*").alias("n"))


@query()
def kmeans_clusters(spark, sf):
    return stats.clusters(table(spark, sf, "embeddings"), 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def kmeans_choice(spark, sf):
    return stats.best_clusters(table(spark, sf, "embeddings"), range(2, 5))


@query()
def pca_components(spark, sf):
    return stats.principal_components(table(spark, sf, "embeddings"))


@query(f"""WITH w AS (SELECT len({sql_words('text')}) AS v FROM documents), s AS (SELECT avg(v) AS mean, stddev_pop(v) AS std, 100.0 * count_if(v < 50) / count(*) AS short_pct, 100.0 * count_if(v > 500) / count(*) AS long_pct, 100.0 * count_if(v BETWEEN 100 AND 300) / count(*) AS optimal_pct FROM w),
 e AS (SELECT avg(sqrt(list_dot_product({E}, {E}))) AS norm, 100.0 * sum(len(list_filter(embedding, lambda x: abs(x) < 1e-6))) / sum(len(embedding)) AS sparsity FROM embeddings)
SELECT array_to_string(list_filter([CASE WHEN std > 0.5 * mean THEN 'sizes vary widely' END, CASE WHEN short_pct > 10 THEN 'many short chunks' END, CASE WHEN long_pct > 5 THEN 'many long chunks' END, CASE WHEN optimal_pct > 70 THEN 'most chunks have a good size' END, CASE WHEN sparsity > 10 THEN 'embeddings are sparse' END, CASE WHEN norm BETWEEN 0.1 AND 10 THEN 'norms are usual' ELSE 'norms are unusual' END], lambda x: x IS NOT NULL), '; ') AS advice FROM s, e""")
def quality_advice(spark, sf):
    w = t.word_count(F.col("text"))
    d = docs(spark, sf)
    vectors = stats.embedding_stats(table(spark, sf, "embeddings")).select("sparsity_pct", "mean_norm")
    both = stats.size_stats(d, w).crossJoin(stats.size_flags(d, w)).crossJoin(vectors)  # one row each
    return stats.advice(both).select(F.array_join("advice", "; ").alias("advice"))


@query(f"SELECT value, count(*) AS n, round(CAST(sum(count(*)) OVER (ORDER BY value) AS BIGINT) / CAST(sum(count(*)) OVER () AS BIGINT), 6) AS cumulative FROM (SELECT CAST(len({sql_words('text')}) AS INTEGER) AS value FROM documents) GROUP BY value")
def word_ecdf(spark, sf):
    return stats.ecdf(docs(spark, sf), t.word_count(F.col("text")))


@query(f"SELECT role, conv_id % 10 AS file, count(*) AS calls, CAST(sum({sql_tokens('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY GROUPING SETS ((role), (conv_id % 10), ())")
def token_usage(spark, sf):
    c = table(spark, sf, "conversations").select("role", (F.col("conv_id") % 10).alias("file"), t.token_estimate(F.col("text")).alias("tokens"))
    return c.groupingSets([["role"], ["file"], []], "role", "file").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


@query(f"SELECT conv_id, turn, recency FROM (SELECT *, CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS INTEGER) AS recency FROM conversations) WHERE recency <= {HISTORY_LENGTH}")
def history_last_n(spark, sf):
    c = table(spark, sf, "conversations").withColumn("newest", F.struct("conv_id", "turn"))
    return context.last_history(c, "role", F.desc("newest"), HISTORY_LENGTH).select("conv_id", "turn", "recency")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC")
def history_sorted(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round((avg(value) - (SELECT avg(value) FROM events)) / (SELECT avg(value) FROM events) * 100, 6) AS overhead_pct FROM events GROUP BY 1")
def latency_stats(spark, sf):
    e = table(spark, sf, "events")
    base = e.agg(F.avg("value").alias("base"))
    each = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return each.crossJoin(F.broadcast(base)).select("event_type", F.round("m", 6).alias("mean"), "std", "min", "max", F.round((F.col("m") - F.col("base")) / F.col("base") * 100, 6).alias("overhead_pct"))


@query("SELECT 'd' || doc_id AS chunk_id, 'text' AS chunk_type, lang, NULL AS page FROM documents UNION ALL SELECT 'p' || page_id, 'table', NULL, page_id FROM pages")
def union_chunks(spark, sf):
    a = docs(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("text").alias("chunk_type"), "lang")
    b = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("chunk_id"), F.lit("table").alias("chunk_type"), F.col("page_id").alias("page"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT source || '_chunk_' || n AS chunk_id, CAST(g - 1 AS BIGINT) AS chunk_index FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, row_number() OVER (ORDER BY source, doc_id) AS g FROM documents)")
def chunk_ids(spark, sf):
    """Ids by document and one sequence over all, whose global part comes from counts by document."""
    from pyspark.sql import Window

    d = docs(spark, sf).select("source", "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    sizes = d.groupBy("source").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("source")) - F.col("size")).drop("size")
    return d.join(before, "source").select(F.concat("source", F.lit("_chunk_"), F.col("n").cast("string")).alias("chunk_id"), (F.col("before") + F.col("n") - 1).alias("chunk_index"))


@query("SELECT conv_id, max(greatest(length(text), turn * 100)) AS peak FROM conversations GROUP BY 1")
def peak_usage(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.greatest(F.length("text"), F.col("turn") * 100)).alias("peak"))


@query("SELECT label AS cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER () AS BIGINT), 6) AS pct FROM embeddings GROUP BY 1")
def cluster_shares(spark, sf):
    e = table(spark, sf, "embeddings")
    total = e.agg(F.count("*").alias("total"))
    return e.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("cluster", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))
