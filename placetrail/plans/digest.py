"""Report files: small result tables as Markdown and as one self-contained page."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame


def _cell(value) -> str:
    if value is None:
        return "n/a"
    return f"{value:.4g}" if isinstance(value, float) else str(value)


def small_rows(df: DataFrame, most: int = 500) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a result table; one that is larger than a report can hold fails."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has more than {most} rows; aggregate it first")
    return df.columns, [[_cell(v) for v in r] for r in rows]


def markdown_table(header: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in (header, ["---"] * len(header), *rows))


def parse_markdown(text: str) -> list[tuple[str, list[str], list[list[str]]]]:
    """(title, header, rows) of every table under a second-level heading."""
    found = []
    for part in text.split("\n## ")[1:]:
        title, *lines = part.splitlines()
        table = [[c.strip() for c in line.strip("| ").split(" | ")] for line in lines if line.startswith("|")]
        if len(table) > 1:
            found.append((title, table[0], table[2:]))
    return found


def page(tables: list[tuple[str, list[str], list[list[str]]]]) -> str:
    """One page; rows whose `ok` or `transfers` is false come first."""
    parts = []
    for title, header, rows in tables:
        at = next((i for i, h in enumerate(header) if h in ("ok", "transfers")), None)
        shown = sorted(rows, key=lambda r: r[at] != "False") if at is not None else rows
        line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
        parts.append(f"<h2>{html.escape(title)}</h2><table>{line('th', header)}{''.join(line('td', r) for r in shown)}</table>")
    return f"<!doctype html><meta charset=utf-8><title>Report</title><style>td,th{{padding:2px 8px;text-align:right}}</style>{''.join(parts)}"


def build_report(tables: dict[str, DataFrame], folder: str) -> None:
    """summary.md and report.html of named result tables."""
    read = [(title, *small_rows(df)) for title, df in tables.items()]
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    (target / "summary.md").write_text("# Summary\n" + "".join(f"\n## {t}\n\n{markdown_table(h, r)}\n" for t, h, r in read))
    (target / "report.html").write_text(page(read))
