"""HTML report of a backtest summary: a table of metrics and inline charts of small series."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

LABELS = {
    "ret_annual": ("Annual return", "percent"),
    "ret_sharpe": ("Sharpe ratio", "ratio"),
    "ret_sortino": ("Sortino ratio", "ratio"),
    "ret_max_dd": ("Maximum drawdown", "percent"),
    "ret_calmar": ("Calmar ratio", "ratio"),
    "turnover_ratio": ("Turnover", "ratio"),
    "win_rate": ("Win rate", "percent"),
}


def formatted(value: float | None, kind: str) -> str:
    """A metric as text: percentages with two decimals, ratios with three, whole numbers as they are."""
    if value is None or value != value:
        return "n/a"
    return f"{value:.2%}" if kind == "percent" else f"{value:.0f}" if kind == "integer" else f"{value:.3f}"


def _line(points: list[float], width: int = 420, height: int = 90) -> str:
    if len(points) < 2:
        return ""
    low, high = min(points), max(points)
    span = (high - low) or 1.0
    at = " ".join(f"{k * width / (len(points) - 1):.1f},{height - (p - low) / span * height:.1f}" for k, p in enumerate(points))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" role="img"><polyline fill="none" stroke="#2b5fa8" points="{at}"/></svg>'


def render(summary: DataFrame, series: DataFrame | None = None, title: str = "Backtest") -> str:
    """A page of the summary (a row a fee and side) and of (name, dt, value) series, one row a date."""
    rows = summary.orderBy("cost", "side").collect()
    metrics = [m for m in LABELS if m in summary.columns]
    head = "".join(f"<th>{LABELS[m][0]}</th>" for m in metrics)
    body = "".join(f"<tr><td>{html.escape(r['cost'])}</td><td>{html.escape(r['side'])}</td>" + "".join(f"<td>{formatted(r[m], LABELS[m][1])}</td>" for m in metrics) + "</tr>" for r in rows)
    charts = ""
    if series is not None:
        lines: dict[str, list[float]] = {}
        for r in series.orderBy("name", "dt").collect():
            lines.setdefault(r["name"], []).append(r["value"] or 0.0)
        charts = "".join(f"<figure><figcaption>{html.escape(n)}</figcaption>{_line(v)}</figure>" for n, v in lines.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th>Cost</th><th>Side</th>{head}</tr>{body}</table>{charts}</body></html>"
