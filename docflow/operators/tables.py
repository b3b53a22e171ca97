"""Tables: markdown, boundaries from a layout, parts within a token budget."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import token_estimate

SINGLE, PART = 512, 450


def render_row(cells: Column) -> Column:
    """P25: cells between pipes; pipes inside are escaped, missing cells are empty."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def separator(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(cells)), " | "), F.lit(" |"))


def grid_to_markdown(grid: Column) -> Column:
    """A grid (array of arrays of strings); its first row is the header."""
    first = F.get(grid, 0)
    return F.array_join(F.concat(F.array(render_row(first), separator(first)), F.transform(F.slice(grid, 2, F.greatest(F.size(grid), F.lit(1))), render_row)), "\n")


def rows_to_markdown(rows: DataFrame, header: list[str], order: str) -> DataFrame:
    """table_id and markdown from rows (table_id, cells, <order>) and a fixed header."""
    head = F.array(*[F.lit(h) for h in header])
    body = F.array_join(F.sort_array(F.collect_list(F.struct(order, render_row(F.col("cells")).alias("line"))))["line"], "\n")
    return rows.groupBy("table_id").agg(body.alias("body")).select("table_id", F.concat_ws("\n", render_row(head), separator(head), "body").alias("markdown"))


def pack_rows(rows: DataFrame) -> DataFrame:
    """Rows (table_id, row_index, line, tokens; row 0 is the header, with its separator) to parts: one if all fit into 512 tokens,
    else the header repeated and rows packed to 450; null tokens count as 0. table_id, part, n_parts, content.

    The rows of a table pass in order, so that a task holds one part at a time and the work grows with the rows.
    """
    total = F.coalesce(F.sum("tokens").over(Window.partitionBy("table_id")), F.lit(0)).cast("long")
    ordered = rows.select("table_id", "row_index", "line", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), total.alias("total"))
    ordered = ordered.repartition("table_id").sortWithinPartitions("table_id", "row_index", "line", "tokens")
    kind = rows.schema["table_id"].dataType.simpleString()

    def run(batches):
        begun, table, head, lines, room, held, part = False, None, None, [], 0, 0, 1
        for batch in batches:
            out = []
            for t, line, tokens, total in zip(*(batch.column(c).to_pylist() for c in ("table_id", "line", "tokens", "total")), strict=True):
                if not begun or t != table:
                    if begun:
                        out.append((table, part, "\n".join([*head, *lines])))
                    begun, table, head, lines, held, part = True, t, [] if line is None else [line], [], 0, 1
                    room = 1 << 62 if total <= SINGLE else PART - tokens
                    continue
                if held > 0 and held + tokens > room:
                    out.append((table, part, "\n".join([*head, *lines])))
                    lines, held, part = [], 0, part + 1
                held += tokens
                if line is not None:
                    lines.append(line)
            yield packed(out, batch.schema.field("table_id").type)
        if begun:
            yield packed([(table, part, "\n".join([*head, *lines]))], batch.schema.field("table_id").type)

    def packed(out, key):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], c) for i, c in enumerate((key, pa.int32(), pa.string()))], ["table_id", "part", "content"])

    parts = ordered.mapInArrow(run, f"table_id {kind}, part int, content string")
    n = F.count("*").over(Window.partitionBy("table_id"))
    return parts.select("table_id", "part", n.cast("int").alias("n_parts"), "content")


def part_title(title: Column, part: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(title, F.lit(" (Part "), part.cast("string"), F.lit(" of "), n.cast("string"), F.lit(")"))).otherwise(title)


def layout_tables(layouts: DataFrame) -> DataFrame:
    """Layouts (doc_id, layout) to table_index, table_id, rows, cols, headers, page, caption, grid. The caption is the nearer of
    the two children of the body before the table that speaks of a following table."""
    t = layouts.select("doc_id", "layout.texts", F.posexplode("layout.tables").alias("table_index", "t"), F.col("layout.body.children").alias("children"))
    grid = F.transform("t.data.grid", lambda r: F.transform(r, lambda c: c["text"]))
    at = F.array_position(F.transform("children", lambda c: c["$ref"]), F.concat(F.lit("#/tables/"), F.col("table_index").cast("string"))).cast("int")
    text_of = lambda ref: F.get(F.transform(F.filter("texts", lambda x: x["self_ref"] == ref), lambda x: x["text"]), 0)
    usable = lambda x: F.when(F.lower(x).contains("following table") & ~F.lower(x).contains("table of contents"), x)
    before = [F.when(at > k, usable(text_of(F.get(F.transform("children", lambda c: c["$ref"]), at - 1 - k)))) for k in (1, 2)]
    page = F.coalesce(F.get("t.prov", 0)["page_no"], F.get("t.prov", 0)["page"])
    return t.select("doc_id", "table_index", F.concat(F.lit("table_"), F.col("table_index").cast("string")).alias("table_id"), F.size(grid).alias("num_rows"), F.coalesce(F.size(F.get(grid, 0)), F.lit(0)).alias("num_cols"), F.get(grid, 0).alias("headers"), page.alias("page"), F.coalesce(*before).alias("caption"), grid.alias("grid"))


def tokens_of(line: Column) -> Column:
    return token_estimate(line)
