"""Contexts for answers: ranked chunks within a budget of characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

MAX_CHARS = 6000
#: How a table chunk and its rows begin, and the source label.
TABLE, ROW, SOURCE = "Bảng, trang PDF ", "Dòng ", "Nguồn"

SCHEMA = "query_id long, context string, sources int, used int, truncated boolean"


def pack(rows: list[tuple[str, list[str], str]], budget: int = MAX_CHARS, numbered: bool = False) -> tuple[str, int, int, bool]:
    """(context, sources, characters, truncated) of (title, path, content) rows in rank order.

    Plain text is cut where the budget ends, and then the context is full. A table is cut after a whole
    row, or passed over while later rows may still fit.
    """
    taken: list[str] = []
    used, full, truncated = 0, False, False
    for title, path, content in rows:
        label = " > ".join([title, *([" > ".join(path)] if path else [])])
        head = (f"[S{len(taken) + 1}] " if numbered else "") + f"[{SOURCE}: {label}]\n"
        gap = 2 if taken else 0
        room = budget - used - gap - len(head)
        if full or room <= 0:
            full = truncated = True
            continue
        body = content[:room]
        if len(body) < len(content):
            truncated = True
            if content.startswith(TABLE):
                if content[len(body)] != "\n":
                    body = body.rpartition("\n")[0]
                if not any(line.startswith(ROW) for line in body.split("\n")):
                    continue
        taken.append(head + body)
        used += gap + len(head) + len(body)
    return "\n\n".join(taken), len(taken), used, truncated


def assemble(rows: DataFrame, budget: int = MAX_CHARS, numbered: bool = True) -> DataFrame:
    """One context for each query_id of (query_id, rank, title, path, content).

    A query has as many rows as its search returned, so a group is small by construction.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ranked = group.sort_values("rank")
        packed = pack([(t or "", list(p) if p is not None else [], c or "") for t, p, c in zip(ranked["title"], ranked["path"], ranked["content"], strict=True)], budget, numbered)
        return pd.DataFrame([(int(group["query_id"].iloc[0]), *packed)], columns=["query_id", "context", "sources", "used", "truncated"])

    return rows.groupBy("query_id").applyInPandas(run, SCHEMA)
