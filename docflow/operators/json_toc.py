"""Contents that a JSON document states itself, at any depth."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.schema import TOC_ENTRY

# Keys that hold a list of contents, and keys that hold sections.
LIST_KEYS = ("toc", "contents", "table_of_contents")
SECTION_KEYS = ("sections", "chapters", "parts")


def _page(item: dict) -> int | None:
    page = item.get("page", item.get("page_number"))
    return page if isinstance(page, int) else int(page) if isinstance(page, str) and page.isdigit() else None


def _entry(item: dict, level: int, title: str, confidence: float) -> dict:
    label = item.get("id", item.get("section_id"))
    return {"level": level, "title": str(item.get("title", item.get("name", title))), "page": _page(item), "section_id": None if label is None else str(label), "line_number": None, "confidence": confidence}


def entries(text: str | None) -> list[dict]:
    """Entries in document order, found with a stack of what is still to be read; no entries for what is not JSON."""
    try:
        todo: list[tuple] = [("value", json.loads(text or ""), 1)]
    except ValueError:
        return []
    out: list[dict] = []
    while todo:
        kind, value, level = todo.pop()
        if kind == "entry":
            out.append(value)
            continue
        found: list[tuple] = []
        if isinstance(value, list):
            found = [("value", x, level) for x in value]
        elif isinstance(value, dict):
            for key, inner in value.items():
                if key.lower() in LIST_KEYS:
                    found += [("entry", _entry(x, x.get("level", 1), "Untitled", 0.95), 0) for x in (inner if isinstance(inner, list) else []) if isinstance(x, dict)]
                elif key.lower() in SECTION_KEYS and isinstance(inner, list):
                    for i, x in enumerate(inner):
                        if isinstance(x, dict):
                            found.append(("entry", _entry(x, level, f"Section {i + 1}", 0.9), 0))
                            if "subsections" in x:
                                found.append(("value", {"sections": x["subsections"]}, level + 1))
                elif isinstance(inner, dict | list):
                    found.append(("value", inner, level))
        todo.extend(reversed(found))
    return out


def json_contents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the entries of every document's JSON."""

    @F.pandas_udf(f"array<{TOC_ENTRY}>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(entries)

    return docs.select("doc_id", F.inline(read(F.col(text))))
