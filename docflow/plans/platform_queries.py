"""What Spark adds to the platform, over the harness's other tables: windows over events, grouping, set operations, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.plans.common import ORACLE_SQL, query, table
from docflow.streaming import events


def log(spark, sf):
    return table(spark, sf, "events")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return events.tumbling(log(spark, sf))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY ALL")
def events_sliding(spark, sf):
    return events.sliding(log(spark, sf))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def events_sessions(spark, sf):
    return events.sessions(log(spark, sf))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def events_totals(spark, sf):
    return log(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf):
    l = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey = 1 GROUP BY 1""")
def region_revenue(spark, sf):
    r = table(spark, sf, "region").where("r_regionkey = 1")
    n = table(spark, sf, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def order_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def document_cube(spark, sf):
    return table(spark, sf, "documents").cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def good_english(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def idle_customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT s_suppkey, p_partkey, revenue, rank FROM (SELECT l_suppkey AS s_suppkey, l_partkey AS p_partkey, round(sum(l_extendedprice), 2) AS revenue, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY round(sum(l_extendedprice), 2) DESC, l_partkey) AS INTEGER) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 3")
def top_parts(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    w = Window.partitionBy("s_suppkey").orderBy(F.desc("revenue"), "p_partkey")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query(ORACLE_SQL["events_tumbling"])
def events_stream(spark, sf):
    """The hourly windows as a stream run to its end: each batch's complete result replaces the one before."""
    import uuid

    from docflow.session import checkpoint_dir

    base = f"{checkpoint_dir(spark)}/docflow/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)

    def write(batch, _):
        batch.write.mode("overwrite").parquet(base + "/out")

    events.tumbling(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", base + "/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(base + "/out")


@query("SELECT doc_id, 1 AS level, 'Doc ' || doc_id AS title, CAST(doc_id % 9 AS INTEGER) AS page, CAST(doc_id AS VARCHAR) AS section_id, 0.95::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, 1, 'Section 1', CAST(7 AS INTEGER), NULL, 0.9::DOUBLE FROM documents UNION ALL SELECT doc_id, 2, lang, NULL, NULL, 0.9::DOUBLE FROM documents")
def json_contents(spark, sf):
    """T27 over JSON made of each document."""
    from docflow.operators.json_toc import json_contents as read

    d = F.col("doc_id")
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("Doc "), d.cast("string")).alias("title"), (d % 9).alias("page"), d.alias("id"))).alias("toc"), F.array(F.struct(F.lit("7").alias("page"), F.array(F.struct(F.col("lang").alias("name"))).alias("subsections"))).alias("sections")))
    return read(table(spark, sf, "documents").select("doc_id", body.alias("text"))).select("doc_id", "level", "title", "page", "section_id", "confidence")


@query()
def ner_rules(spark, sf):
    """E10-E12 with the offline rules as the model."""
    from docflow.operators.models import with_ner
    from docflow.plans.entity_queries import text

    return with_ner(text(spark, sf).withColumnRenamed("t", "content")).select("doc_id", F.to_json("ner").alias("ner"))


@query()
def hashed_embeddings(spark, sf):
    """X8 over whole texts."""
    from docflow.functions.encode import hashing_encoder

    return table(spark, sf, "documents").select("doc_id", hashing_encoder(F.col("text")).alias("embedding"))
