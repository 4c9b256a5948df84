"""A report of a model's summaries as one HTML page, from small DataFrames."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def render(title: str, sections: dict[str, DataFrame], rows: int = 1000) -> str:
    """Tables of at most ``rows`` rows each (they are summaries)."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out) + "</body></html>"
