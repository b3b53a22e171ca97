"""Document structure: headings, their hierarchy, the heading of a chunk, tables of contents."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.session import ship

# White space as in Java's \s.
WHITE = " \t\n\x0b\f\r"
SPACE, LINE_END = re.compile(f"[{WHITE}]+"), re.compile("\n")
#: Documents whose chunks are lists in Python at once.
DOCUMENTS = 256

# Patterns of a table of contents.
KEYWORDS = r"(?i)\b(?:table\s+of\s+contents?|toc|contents?|index|outline|summary|chapter\s+list)\b"
KEYWORD_SIGNS = ["toc", "content", "index", "outline", "summary", "chapter"]
DOTTED = r"^(.+?)\.{2,}\s*(\d+)$"
SPACED = r"^(.+?)\s{3,}(\d+)$"
PIPED = r"^\|\s*(.+?)\s*\|.*?\|\s*(\d+)\s*\|?$"
NUMBERED = r"^\s*(\d+)\.\s+(.+)$"
DOUBLE_NUMBERED = r"^\s*(\d+\.\d+)\.\s+(.+)$"
STRUCTURE = r"(?i)^[|\-*•]|\b(?:item|part|section|chapter)\b|\.{2,}|:.*\d+$"
PAGE_WEIGHT, STRUCTURE_WEIGHT, KEYWORD_BONUS, EARLY_BONUS, NUMBERED_BONUS = 0.7, 0.3, 0.5, 0.2, 0.3
DENSE, ACCEPTED, FIRST_LINES = 0.15, 0.5, 1000
LONG_LINE, SECTION_LINES, BLANK_LINES = 120, 80, 4
#: Levels of headings that can be ancestors.
MAX_LEVEL = 12
POSITION_WORDS = ["chapter", "part", "section", "item"]
SUBSECTION_WORDS = ["subsection", "appendix", "annex"]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_number (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line_number", "line"))


def headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_number, level, heading."""
    s = trimmed(F.col("line"))
    found = lines(docs, text).withColumn("level", F.length(F.regexp_extract(s, "^(#+)", 1))).withColumn("heading", trimmed(F.regexp_replace(s, "^#+", "")))
    return found.where((F.col("level") > 0) & (F.col("heading") != "")).select("doc_id", "line_number", "level", "heading")


def heading_asof(chunks: DataFrame, heads: DataFrame, carried: tuple[str, ...] = ("level", "heading")) -> DataFrame:
    """Chunks (doc_id, chunk_id, line_number) with the carried columns of the last heading at or before their line, else of the
    document's first.

    An as-of join as one union and a running last value: one shuffle by document, linear in its lines.
    """
    left = chunks.select("doc_id", "line_number", F.lit(1).alias("kind"), "chunk_id", *[F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in carried])
    right = heads.select("doc_id", "line_number", F.lit(0).alias("kind"), F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), *carried)
    order = Window.partitionBy("doc_id").orderBy("line_number", "kind")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = F.when(F.col("kind") == 0, F.struct(*carried))
    both = left.unionByName(right).withColumn("h", F.coalesce(F.last(h, ignorenulls=True).over(upto), F.first(h, ignorenulls=True).over(whole)))
    return both.where("kind = 1").select("doc_id", "chunk_id", "line_number", *[F.col(f"h.{c}").alias(c) for c in carried])


def headings_over(text: str | None, contents: list[str | None]) -> list[tuple[list[str], list[int]] | None]:
    """T6, T7 for one document: path and levels of the headings over each of its chunks, as headings, heading_paths and heading_asof give
    them; None in a document without headings.

    A chunk lies where it begins, by its first five words (its first 50 characters where these are under 10), then the same in the text
    with single spaces; one that is not found lies under the last heading.
    """
    at, over, above = [], [], []
    for n, line in enumerate((text or "").split("\n")):
        line = line.strip(WHITE)
        heading = line.lstrip("#")
        level, heading = len(line) - len(heading), heading.strip(WHITE)
        if level and heading:
            while above and above[-1][0] >= level:
                above.pop()
            at.append(n)
            over.append(([*(h for _, h in above[-2:]), heading], [*(n for n, _ in above[-2:]), level]))
            if level <= MAX_LEVEL:
                above.append((level, heading))
    if not at:
        return [None] * len(contents)
    ends = [m.start() for m in LINE_END.finditer(text)]
    spaced, out = None, []
    for content in contents:
        found = -1
        if content is not None:
            probe = " ".join(w for w in SPACE.split(content.lstrip(WHITE), 5)[:5] if w)
            probe = content[:50] if len(probe) < 10 else probe
            found = text.find(probe)
            if found < 0:
                spaced = SPACE.sub(" ", text.strip(WHITE)) if spaced is None else spaced
                found = spaced.find(SPACE.sub(" ", probe.strip(WHITE)))
        out.append(over[max(0, bisect_right(at, bisect_left(ends, found)) - 1)] if found >= 0 else over[-1])
    return out


def chunk_headings(chunks: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, chunk_id, path and levels of the headings over each chunk (doc_id, chunk_id, content); a chunk that is not found
    lies under the last heading, a document without headings gives nulls. The chunks of a document meet its text once, in one row."""
    ship(docs.sparkSession)
    together = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", "content")).alias("chunks"))
    rows = together.join(docs.select("doc_id", F.col(text).alias("text")), "doc_id").select("doc_id", "text", "chunks")
    kind = lambda frame, c: frame.schema[c].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(start, DOCUMENTS)
                own = part.column(2)
                n, each = pc.list_value_length(own).to_pylist(), own.flatten()
                contents, at, over = each.field(1).to_pylist(), 0, []
                for t, k in zip(part.column(1).to_pylist(), n, strict=True):
                    over.extend(headings_over(t, contents[at : at + k]))
                    at += k
                docs_of = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                path, levels = ([None if o is None else o[i] for o in over] for i in range(2))
                yield pa.RecordBatch.from_arrays([docs_of, each.field(0), pa.array(path, pa.list_(pa.string())), pa.array(levels, pa.list_(pa.int32()))], ["doc_id", "chunk_id", "path", "levels"])

    return rows.mapInArrow(run, f"doc_id {kind(chunks, 'doc_id')}, chunk_id {kind(chunks, 'chunk_id')}, path array<string>, levels array<int>")


def heading_paths(heads: DataFrame) -> DataFrame:
    """Each heading with up to two ancestors of strictly decreasing level, the outermost first.

    The nearest heading of a lower level is the latest of the last headings of each lower level, so a row carries one place for
    each of MAX_LEVEL levels, not all headings before it; deeper levels count as MAX_LEVEL + 1, under all others.
    """
    before = Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.struct(F.col("line_number").alias("at"), F.col("level").alias("level"), F.col("heading").alias("heading"))), ignorenulls=True).over(before) for n in range(1, MAX_LEVEL + 1)]
    seen = heads.withColumn("last", F.array(*last))

    def nearest(level: Column, at: Column) -> Column:
        return F.array_max(F.filter("last", lambda h: h.isNotNull() & (h["level"] < level) & (h["at"] < at)))

    up = seen.withColumn("a", nearest(F.col("level"), F.col("line_number"))).withColumn("b", nearest(F.col("a")["level"], F.col("a")["at"]))
    path = F.array_compact(F.array(F.col("b")["heading"], F.col("a")["heading"], F.col("heading")))
    levels = F.array_compact(F.array(F.col("b")["level"], F.col("a")["level"], F.col("level")))
    return up.select("doc_id", "line_number", "level", "heading", path.alias("path"), levels.alias("levels"))


def prepend_headings(path: Column, levels: Column, content: Column) -> Column:
    """A line for each heading above the content."""
    return F.array_join(F.concat(F.zip_with(path, levels, lambda h, n: F.concat(F.repeat(F.lit("#"), n), F.lit(" "), h, F.lit(" [H"), n.cast("string"), F.lit("]"))), F.array(content)), "\n\n")


def truncate_corrupt(path: Column) -> Column:
    """Headings with GLYPH: over 50 characters are cut, those of 10 or fewer go."""
    glyph = lambda h: h.contains("GLYPH")
    kept = F.filter(path, lambda h: ~(glyph(h) & (F.length(h) <= 10)))
    return F.transform(kept, lambda h: F.when(glyph(h) & (F.length(h) > 50), F.concat(F.substring(h, 1, 50), F.lit("..."))).otherwise(h))


# Tables of contents


def has_page(line: Column) -> Column:
    return line.rlike(DOTTED) | line.rlike(SPACED) | line.rlike(PIPED)


def marked_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and rows: flags of each of the first 1,000 lines; stop: a section of contents ends there."""
    flag = lambda c: c.cast("int")
    trim = F.transform(F.slice(F.split(F.col(text), "\n"), 1, FIRST_LINES), trimmed)
    # One after another, as each pattern is costly and is looked for once, and only where a plain sign says that it may be there.
    plain = F.transform(trim, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low"), F.substring(s, -1, 1).between("0", "9").alias("digit")))
    holds = lambda low, signs: reduce(Column.__or__, [low.contains(w) for w in signs])
    paged = F.transform(plain, lambda x: F.struct(x["s"].alias("s"), x["low"].alias("low"), x["digit"].alias("digit"), flag(F.when(x["digit"] | x["s"].endswith("|"), has_page(x["s"])).otherwise(False)).alias("page")))

    def structured(x: Column) -> Column:
        s = x["s"]
        may = (x["page"] == 0) & (s.startswith("|") | s.startswith("-") | s.startswith("*") | s.startswith("•") | s.contains("..") | (x["digit"] & s.contains(":")) | holds(x["low"], POSITION_WORDS))
        return F.struct(s.alias("s"), x["low"].alias("low"), x["page"].alias("page"), flag(F.when(may, s.rlike(STRUCTURE)).otherwise(False)).alias("structure"))

    built = F.transform(paged, structured)

    def flags(x: Column) -> Column:
        s, low = x["s"], x["low"]
        stop = (s.startswith("#") & ~low.contains("table") & ~low.contains("content")) | ((F.length(s) > LONG_LINE) & (x["page"] == 0) & (x["structure"] == 0))
        keyword = F.when(holds(low, KEYWORD_SIGNS), s.rlike(KEYWORDS)).otherwise(False)
        return F.struct(flag(s != "").alias("filled"), x["page"].alias("page"), x["structure"].alias("structure"), flag(keyword).alias("keyword"), flag(s.rlike(NUMBERED)).alias("numbered"), stop.alias("stop"))

    return docs.select("doc_id", F.transform(built, flags).alias("rows"))


def density(pages: Column, structures: Column, filled: Column) -> Column:
    """T20."""
    return F.when(filled > 0, pages / filled * PAGE_WEIGHT + structures / filled * STRUCTURE_WEIGHT).otherwise(0.0)


def window_size(n: Column) -> Column:
    return F.least(F.lit(15), F.greatest(F.lit(5), F.floor(n / 150).cast("int")))


def totals(part: Column, names: tuple[str, ...]) -> Column:
    """A struct of the sums of these flags over rows."""
    return F.aggregate(part, F.struct(*[F.lit(0).alias(c) for c in names]), lambda a, x: F.struct(*[(a[c] + x[c]).alias(c) for c in names]))


def windows(rows: Column) -> Column:
    """Structs (start_line, window_lines, score) of a document's windows over the threshold."""
    n = F.size(rows)
    w = window_size(n)
    starts = F.when(n > w, F.sequence(F.lit(0), n - w - 1, F.greatest(F.lit(2), F.floor(w / 2).cast("int")))).otherwise(F.array().cast("array<int>"))
    summed = F.transform(starts, lambda i: F.struct(i.alias("start_line"), w.alias("window_lines"), totals(F.slice(rows, i + 1, w), ("filled", "page", "structure")).alias("t")))
    scored = F.transform(summed, lambda x: F.struct(x["start_line"].alias("start_line"), x["window_lines"].alias("window_lines"), F.round(density(x["t"]["page"], x["t"]["structure"], x["t"]["filled"]), 6).alias("score")))
    return F.filter(scored, lambda x: x["score"] > DENSE)


def dense_windows(marked: DataFrame) -> DataFrame:
    """doc_id, start_line, window_lines, score of windows over the threshold, without a shuffle."""
    # Not inline: Spark would look for empty arrays first, and make them twice.
    return marked.select("doc_id", F.inline_outer(windows(F.col("rows")))).where(F.col("start_line").isNotNull())


def section_end(rows: Column, start: Column) -> Column:
    """The line where the section from start ends."""

    def step(acc: Column, x: Column) -> Column:
        blank = F.when(x["filled"] == 0, acc["blank"] + 1).otherwise(0)
        done = acc["done"] | x["stop"] | (blank >= BLANK_LINES)
        return F.struct(F.when(done, acc["end"]).otherwise(acc["end"] + 1).alias("end"), blank.alias("blank"), done.alias("done"))

    first = F.struct((start + 1).alias("end"), F.lit(0).alias("blank"), F.lit(False).alias("done"))
    return F.aggregate(F.slice(rows, start + 2, SECTION_LINES - 1), first, step)["end"]


def toc_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Phases 1 and 2: doc_id, start_line, end_line, score, reason of sections opened by a keyword or by density. Each document is a row
    of flags of its lines, so nothing is shuffled and each line is looked at once."""
    rows = F.col("rows")
    candidate = lambda start, bonus, reason, known: F.struct(start.alias("start_line"), F.lit(bonus).alias("bonus"), F.lit(reason).alias("reason"), known.cast("double").alias("known"))
    numbers = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
    opened = F.transform(F.filter(numbers, lambda i: F.get(rows, i)["keyword"] == 1), lambda i: candidate(i, KEYWORD_BONUS, "keyword_triggered", F.lit(None)))
    dense = F.transform(windows(rows), lambda x: candidate(x["start_line"], 0.0, "page_number_density", x["score"]))
    found = marked_lines(docs, text).select("doc_id", "rows", F.inline_outer(F.concat(opened, dense))).where(F.col("start_line").isNotNull())
    cut = found.withColumn("end_line", section_end(rows, F.col("start_line")))
    part = F.slice("rows", F.col("start_line") + 1, F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)))
    cut = cut.withColumn("t", totals(part, ("filled", "page", "structure", "numbered")))
    own = density(F.col("t.page"), F.col("t.structure"), F.col("t.filled"))
    early = F.when(F.col("start_line") / F.size("rows") < 0.3, EARLY_BONUS).otherwise(0.0)
    numbered = F.when(F.col("t.numbered") >= 2, NUMBERED_BONUS).otherwise(0.0)
    score = F.round(F.coalesce("known", own) + F.col("bonus") + early + numbered, 6)
    return cut.where("end_line > start_line").select("doc_id", "start_line", "end_line", score.alias("score"), "reason")


def select_candidates(found: DataFrame) -> DataFrame:
    """Of each document the best and the best of those that do not overlap it, if over 0.5."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start_line", "end_line", "reason")
    first = found.withColumn("pick", F.row_number().over(order)).where("pick = 1")
    ends = first.select("doc_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    apart = found.join(ends, "doc_id").where((F.col("start_line") >= F.col("e")) | (F.col("end_line") <= F.col("s"))).drop("s", "e")
    second = apart.withColumn("pick", F.row_number().over(order)).where("pick = 1").withColumn("pick", F.lit(2))
    return first.unionByName(second).where(F.col("score") > ACCEPTED)


def toc_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """T25 over all lines: doc_id, line_number, level, title, page, confidence."""
    s = trimmed(F.col("line"))
    pages = [(F.regexp_extract(s, p, 1), F.regexp_extract(s, p, 2), s.rlike(p)) for p in (DOTTED, SPACED, PIPED)]
    title, page = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, n, hit in reversed(pages):
        title, page = F.when(hit, trimmed(t)).otherwise(title), F.when(hit, n).otherwise(page)
    numbered, double = s.rlike(NUMBERED), s.rlike(DOUBLE_NUMBERED)
    rows = lines(docs, text).select("doc_id", "line_number", "line", s.alias("s"), title.alias("paged"), page.alias("page"), numbered.alias("numbered"), double.alias("double"))
    indent = F.length(F.regexp_extract(F.col("line"), r"^(\s*)", 1))
    low = F.lower("paged")
    starts, holds = F.lit(False), F.lit(False)
    for w in POSITION_WORDS:
        starts = starts | low.startswith(w)
    for w in SUBSECTION_WORDS:
        holds = holds | low.contains(w)
    level = F.least(F.when(starts, 1).when(holds, 2).otherwise(F.floor(indent / 4).cast("int") + 1), F.lit(6))
    return rows.where(F.col("paged").isNotNull() | F.col("numbered") | F.col("double")).select(
        "doc_id", "line_number",
        F.when(F.col("paged").isNotNull(), level).when(F.col("numbered"), 1).otherwise(2).alias("level"),
        F.coalesce("paged", F.when(F.col("numbered"), trimmed(F.regexp_extract("s", NUMBERED, 2))).otherwise(trimmed(F.regexp_extract("s", DOUBLE_NUMBERED, 2)))).alias("title"),
        F.expr("try_cast(page as int)").alias("page"), F.when(F.col("paged").isNotNull(), 0.9).otherwise(0.7).alias("confidence"),
    )


def confirm_by_headings(selected: DataFrame, entries: DataFrame, heads: DataFrame, first: int = 50) -> DataFrame:
    """0.1 more where a title of the section and one of the first headings contain each other."""
    early = heads.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_number"))).where(F.col("n") <= first).select("doc_id", F.lower("heading").alias("h"))
    near = entries.select("doc_id", "line_number", F.lower("title").alias("t")).join(early, "doc_id").where(F.contains("t", F.col("h")) | F.contains("h", F.col("t"))).select("doc_id", "line_number").distinct()
    inside = selected.join(near, "doc_id", "left").withColumn("hit", F.coalesce(F.col("line_number").between(F.col("start_line"), F.col("end_line") - 1), F.lit(False)))
    keys = ["doc_id", "start_line", "end_line", "score", "reason"]
    return inside.groupBy(*keys).agg(F.max("hit").alias("hit")).withColumn("score", F.when(F.col("hit"), F.col("score") + 0.1).otherwise(F.col("score"))).drop("hit")


def layout_toc(tables: DataFrame) -> DataFrame:
    """Rows (doc_id, table_index, row, col, text) of the first ten tables of a layout; entries of the first that looks like contents."""
    early = tables.where(F.col("table_index") < 10)
    order = Window.partitionBy("doc_id", "table_index").orderBy("row", "col")
    probe = early.withColumn("n", F.row_number().over(order)).where("n <= 15")
    sign = F.lower("text").rlike("part i|item 1|item 2|business|page|contents")
    chosen = probe.groupBy("doc_id", "table_index").agg(F.count_if(sign).alias("signs")).where("signs >= 3").groupBy("doc_id").agg(F.min("table_index").alias("table_index"))
    rows = early.join(chosen, ["doc_id", "table_index"]).groupBy("doc_id", "table_index", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text")))["text"].alias("cells"))
    first, last = F.get("cells", 0), F.element_at("cells", -1)
    part, item = F.upper(first).startswith("PART"), F.lower(first).startswith("item")
    return rows.where((F.size("cells") >= 2) & (F.lower(first) != "page") & (part | item)).select(
        "doc_id", "row", F.when(part, 1).otherwise(2).alias("level"), F.when(part, F.array_join("cells", " ")).otherwise(F.concat(first, F.lit(" "), F.get("cells", 1))).alias("title"),
        F.expr("try_cast(element_at(cells, -1) as int)").alias("page"), F.when(part, 0.95).otherwise(0.9).alias("confidence"),
    )
