"""Entity extraction over sentences made of the documents' ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import entities as e
from docflow.plans.common import query, table


def text(spark, sf):
    s = lambda c: c.cast("string")
    made = F.concat(
        F.lit("On 2"), s(F.col("doc_id") % 3), F.lit("/0"), s(1 + F.col("doc_id") % 9), F.lit("/20"), s(10 + F.col("doc_id") % 15), F.lit(" and Mar. "), s(1 + F.col("doc_id") % 28), F.lit(", 2021 (Q"), s(1 + F.col("doc_id") % 4), F.lit(" 2023; in 1850, "), s(1890 + F.col("doc_id") % 150),
        F.lit(") revenue rose "), s(F.col("doc_id") % 50), F.lit(".5% to $3,"), s(100 + F.col("doc_id") % 900), F.lit(" million and 45 billion in Europe, the United States, Japan and the UK; EBITDA growth was quarterly. Fiscal year 2024 profit: "),
        F.lit("Dr. Alice Brown met Tom Reed. CEO Mary Ann and Acme Widget Holdings Inc, Blue Systems Ltd. "), "text",
    )
    return table(spark, sf, "documents").select("doc_id", made.alias("t"))


TEXT = """t AS (SELECT doc_id, 'On 2' || doc_id % 3 || '/0' || (1 + doc_id % 9) || '/20' || (10 + doc_id % 15) || ' and Mar. ' || (1 + doc_id % 28) || ', 2021 (Q' || (1 + doc_id % 4) || ' 2023; in 1850, ' || (1890 + doc_id % 150)
 || ') revenue rose ' || doc_id % 50 || '.5% to $3,' || (100 + doc_id % 900) || ' million and 45 billion in Europe, the United States, Japan and the UK; EBITDA growth was quarterly. Fiscal year 2024 profit: '
 || 'Dr. Alice Brown met Tom Reed. CEO Mary Ann and Acme Widget Holdings Inc, Blue Systems Ltd. ' || text AS t FROM documents)"""


def sql(patterns, each, total, source, keep="x <> ''"):
    """Distinct in the order of their first place, by patterns in order, cut, sorted, joined."""
    lists = []
    for p in patterns:
        pattern = ("(?i)" + p).replace("'", "''")
        found = f"list_transform(regexp_extract_all({source}, '{pattern}'), lambda x: trim(x))"
        lists.append(f"list_filter({found}{f'[1:{each}]' if each else ''}, lambda x: {keep})")
    every = lists[0]
    for x in lists[1:]:
        every = f"list_concat({every}, {x})"
    first = "list_filter(a, lambda x, i: list_position(a, x) = i)"
    return f"WITH {TEXT}, f AS (SELECT doc_id, {every} AS a FROM t) SELECT doc_id, array_to_string(list_sort(({first})[1:{total}]), '|') AS found FROM f"


YEAR = "length(x) <> 4 OR (TRY_CAST(x AS INTEGER) BETWEEN 1900 AND 2030)"


def found(column):
    return F.array_join(column, "|").alias("found")


@query(sql(e.DATES, None, 10, "t", YEAR))
def extract_dates(spark, sf):
    return text(spark, sf).select("doc_id", found(e.dates(F.col("t"))))


@query(sql(e.TIME_PERIODS, 5, 8, "lower(t)"))
def extract_time_periods(spark, sf):
    return text(spark, sf).select("doc_id", found(e.time_periods(F.col("t"))))


@query(sql(e.METRICS, 8, 10, "t"))
def extract_metrics(spark, sf):
    return text(spark, sf).select("doc_id", found(e.metrics(F.col("t"))))


@query(sql(e.REGIONS, 3, 5, "lower(t)"))
def extract_regions(spark, sf):
    return text(spark, sf).select("doc_id", found(e.regions(F.col("t"))))


@query()
def extract_people(spark, sf):
    return text(spark, sf).select("doc_id", found(e.people(F.col("t"))))


@query()
def extract_organizations(spark, sf):
    return text(spark, sf).select("doc_id", found(e.organizations(F.col("t"))))


DATES = "[CAST(1890 + doc_id % 150 AS VARCHAR), 'Q1 ' || (1995 + doc_id % 40), '120245'][1:1 + doc_id % 3]"


@query(f"""WITH y AS (SELECT doc_id, list_filter(list_transform({DATES}, lambda d: list_filter(list_transform(range(1, greatest(length(d) - 3, 1) + 1), lambda i: TRY_CAST(CASE WHEN regexp_matches(substring(d, i, 4), '^\\d{{4}}$') THEN substring(d, i, 4) END AS INTEGER)), lambda w: w BETWEEN 1900 AND 2030)[1]), lambda w: w IS NOT NULL) AS years FROM documents)
SELECT doc_id, CASE WHEN len(years) > 0 THEN (list_min(years) - 1) || '-05-01' END AS start_date, CASE WHEN len(years) > 0 THEN list_max(years) || '-04-30' END AS end_date FROM y""")
def time_context(spark, sf):
    dates = F.slice(F.array((1890 + F.col("doc_id") % 150).cast("string"), F.concat(F.lit("Q1 "), (1995 + F.col("doc_id") % 40).cast("string")), F.lit("120245")), 1, (1 + F.col("doc_id") % 3).cast("int"))
    c = e.time_context(dates)
    return table(spark, sf, "documents").select("doc_id", c["start"].alias("start_date"), c["end"].alias("end_date"))


NAMES = ["Acme Corp", "Windows 11", "the Group", "Blue Premium", "Premium Parts Inc", "X", "Excel Tools", "Form 10", "Northern Works", "and Sons"]


@query(f"SELECT p_partkey, n AS name FROM (SELECT p_partkey, {NAMES!r}[1 + p_partkey % 10] AS n FROM part) WHERE length(trim(n)) >= 2 AND NOT regexp_matches(lower(n), '^(the |and |page |item |form )')")
def entity_filter(spark, sf):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (1 + F.col("p_partkey") % 10).cast("int"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).where(e.usable_entity(F.col("name")))


SIGNS = "|".join(e.PRODUCT_SIGNS)


@query(f"""WITH n AS (SELECT p_partkey, list_distinct([{NAMES!r}[1 + p_partkey % 10], {NAMES!r}[1 + (p_partkey + 3) % 10]]) AS orgs FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(orgs, lambda x: NOT (regexp_matches(lower(x), '{SIGNS}') OR (regexp_matches(lower(x), ' pro| plus| premium| enterprise| 365| 11| 15') AND NOT regexp_matches(lower(x), ' inc| corp| ltd| llc| company| co\\.'))))), '|') AS orgs,
 array_to_string(list_sort(list_filter(orgs, lambda x: (regexp_matches(lower(x), '{SIGNS}') OR (regexp_matches(lower(x), ' pro| plus| premium| enterprise| 365| 11| 15') AND NOT regexp_matches(lower(x), ' inc| corp| ltd| llc| company| co\\.'))))), '|') AS products FROM n""")
def reclassify_products(spark, sf):
    k = F.col("p_partkey")
    at = lambda i: F.element_at(F.array(*map(F.lit, NAMES)), (1 + i % 10).cast("int"))
    n = table(spark, sf, "part").select("p_partkey", F.array_distinct(F.array(at(k), at(k + 3))).alias("orgs"))
    pick = lambda c: F.array_join(F.sort_array(F.filter("orgs", c)), "|")
    return n.select("p_partkey", pick(lambda x: ~e.is_product(x)).alias("orgs"), pick(e.is_product).alias("products"))


@query("""WITH c AS (SELECT doc_id // 5 AS g, doc_id, CASE WHEN doc_id % 15 = 0 THEN text || ' the Company, Inc' WHEN doc_id % 10 = 0 THEN text || ' Elastic' ELSE text END AS t FROM documents),
f AS (SELECT *, first_value(t) OVER (PARTITION BY g ORDER BY doc_id) AS head FROM c)
SELECT doc_id, CASE WHEN lower(head) LIKE '%elastic%' THEN 'Elastic N.V.' WHEN lower(head) LIKE '%company%' AND lower(head) LIKE '%inc%' THEN 'The Company' ELSE '' END AS orgs FROM f""")
def doc_orgs(spark, sf):
    """From the first chunk of each document."""
    from pyspark.sql import Window

    t = F.when(F.col("doc_id") % 15 == 0, F.concat("text", F.lit(" the Company, Inc"))).when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" Elastic"))).otherwise(F.col("text"))
    c = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 5).alias("g"), "doc_id", t.alias("t"))
    head = F.first("t").over(Window.partitionBy("g").orderBy("doc_id"))
    return c.withColumn("head", head).select("doc_id", F.array_join(e.document_orgs(F.lit("report"), F.col("head")), "|").alias("orgs"))


@query()
def populate_entities(spark, sf):
    """At most five of each kind, organisations from the document where a chunk has none."""
    from pyspark.sql import Window

    t = text(spark, sf).select((F.col("doc_id") % 50).alias("doc"), "doc_id", "t")
    doc_orgs = F.first(e.document_orgs(F.col("doc").cast("string"), F.col("t"))).over(Window.partitionBy("doc").orderBy("doc_id"))
    c = F.col("t")
    five = lambda x, n: F.array_join(F.slice(x, 1, 5), "|").alias(n)
    own = t.withColumn("own", e.organizations(c)).withColumn("of_doc", doc_orgs)
    return own.select("doc_id", five(e.dates(c), "dates"), five(e.regions(c), "regions"), five(e.metrics(c), "metrics"), five(e.time_periods(c), "time_periods"), five(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("of_doc")), "orgs"))
