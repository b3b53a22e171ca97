"""Command line: python -m docflow ingest|ask|evaluate|dedupe|export|sample|clear|drop ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from docflow.functions.encode import hashing_encoder
from docflow.operators import evaluate, maintenance, search
from docflow.plans.rag import RagPipeline, ingest
from docflow.session import build_session
from docflow.sources import files, sinks


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="docflow")
    verbs = top.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("ingest", help="files to enriched, embedded chunks")
    v.add_argument("--input-dir", required=True)
    v.add_argument("--output-dir", required=True)
    v.add_argument("--append", action="store_true", help="keep the chunks that are there")
    v = verbs.add_parser("ask", help="a question over chunks")
    v.add_argument("--chunks", required=True)
    v.add_argument("--question", required=True)
    v = verbs.add_parser("evaluate", help="metrics of a run against judgements")
    v.add_argument("--run", required=True, help="Parquet of query_id, rank, doc_id, score")
    v.add_argument("--qrels", required=True)
    v.add_argument("--output-dir", required=True)
    v = verbs.add_parser("dedupe", help="keep the first row of each key")
    v.add_argument("--input", required=True)
    v.add_argument("--key", required=True)
    v.add_argument("--order", required=True)
    v.add_argument("--output-dir")
    v.add_argument("--confirm", action="store_true", help="write the result; else only what would go is counted")
    for verb, help_ in (("export", "chunks as JSON, without null fields"), ("sample", "some chunks, the same each time, with a preview only")):
        v = verbs.add_parser(verb, help=help_)
        v.add_argument("--chunks", required=True)
        v.add_argument("--output-dir", required=True)
        if verb == "sample":
            v.add_argument("--n", type=int, default=20)
    for verb, help_ in (("clear", "all rows of a chunk store go, the store stays"), ("drop", "a chunk store goes with its versions")):
        v = verbs.add_parser(verb, help=help_)
        v.add_argument("--store", required=True)
        v.add_argument("--schema", required=True, help="columns of the store as in SQL")
        v.add_argument("--confirm", action="store_true", help="do it; else only the rows are counted")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark = build_session("docflow")
    if args.verb == "ingest":
        ingest(spark, args.input_dir).write.mode("append" if args.append else "overwrite").parquet(args.output_dir)
        spark.read.parquet(args.output_dir).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents")).show()
    elif args.verb == "ask":
        chunks = spark.read.parquet(args.chunks).select(F.xxhash64("chunk_id").alias("vec_id"), F.col("chunk_id").alias("chunk_key"), "doc_id", F.lit("").alias("section"), "content", "embedding")
        RagPipeline(chunks, hashing_encoder).query(spark.createDataFrame([(1, args.question)], "query_id long, query string")).show(truncate=False)
    elif args.verb == "evaluate":
        metrics = evaluate.evaluate(spark.read.parquet(args.run), evaluate.read_qrels(spark, args.qrels))
        metrics.coalesce(1).write.mode("overwrite").json(args.output_dir)  # one row for each depth
        metrics.orderBy("k").show()
    elif args.verb == "export":
        sinks.write_processed(spark.read.parquet(args.chunks), args.output_dir)
    elif args.verb == "sample":
        rows = files.sample(spark.read.parquet(args.chunks), "chunk_id", args.n)
        sinks.export_sample(rows, True).coalesce(1).write.mode("overwrite").json(args.output_dir)  # n rows
    elif args.verb in ("clear", "drop"):
        store = sinks.ChunkStore(spark, args.store, args.schema)
        print(f"{store.count()} rows")
        if args.confirm:
            store.clear(confirm=True) if args.verb == "clear" else store.drop(confirm=True)
    elif args.confirm:
        search.keep_first(spark.read.parquet(args.input), [args.key], [F.col(args.order)]).write.mode("errorifexists").parquet(args.output_dir)
    else:
        maintenance.duplicate_summary(spark.read.parquet(args.input), args.key).show()


if __name__ == "__main__":
    main()
