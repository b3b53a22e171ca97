"""op6 and op7."""

import duckdb
from pyspark.sql import functions as F

from docflow.llm import chat, queries, sharding


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|>yo"), (1, 3, "ann", None), (2, 0, "system", "x"), (None, None, None, "q"), (3, 300, "bob", "late"), (3, 1, "bob", "e"), (3, 1, "bob", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    out = chat.rotate(df).collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "bob")}
    whole = {(r.conv_id, r.perspective): r for r in chat.dialogues(df).collect()}
    ann = whole[1, "ann"]
    assert ann.dialogue == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<im_end>yo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann.dialogue[m.start : m.end] for m in ann.mask] == ["hi<|im_end|>", "<|im_end|>"]
    assert whole[3, "bob"].dialogue.count("assistant") == 3
    assert chat.rotate(df.limit(0)).count() == 0


def test_perspectives_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(chat.ROTATE_SQL)
    got = queries.op6_chat_perspectives(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def shards_hold(rows, docs, n_shards):
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n_shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return [sum(r.size for r in by.get(i, [])) for i in range(n_shards)]


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op7_virtual_slots(spark, "/root/testdata/sf0.01").collect()
    loads = shards_hold(rows, docs.collect(), 24)
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 24
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards_odd_rows(spark):
    rows = [(None, None), (None, None), (1, "é"), (1, "é"), (2, ""), (3, "x" * 5000)] + [(7, "same")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash")).withColumn("size", F.lit(None))
    out = sharding.shard_documents(docs, 4, 64).collect()
    shards_hold(out, rows, 4)
    assert sorted(r.size for r in out)[:4] == [8, 8, 8, 10] and {r.text_crc32 for r in out if r.doc_id is None} == {0}
    assert sharding.shard_documents(docs.limit(0), 4, 64).count() == 0


def test_map_is_edited(spark):
    loads = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") * 10).alias("bytes"), F.lit(1).cast("long").alias("n_rows"))
    one = sharding.first_map(spark, 4, 64)
    two = sharding.rebalance(one, loads, 4)
    three = sharding.rebalance(two, loads, 5)
    a, b, c = ({r.virtual_slot: r.shard for r in m.collect()} for m in (one, two, three))
    assert sum(a[s] == b[s] for s in a) > 32 and sum(b[s] == c[s] for s in a) > 32
    sums = [sum(10 * s for s in c if c[s] == k) for k in range(5)]
    assert max(sums) - min(sums) <= 100
