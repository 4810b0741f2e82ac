"""Reports of collected aggregates: markdown tables, confusion matrices, JSON, bar, line and heat charts as SVG."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame


def rows_of(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of an aggregate; raises ValueError for more than most."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return rows


def spread(mean: float | None, sd: float | None) -> str:
    """0.000±0.000, or a dash."""
    return "—" if mean is None else f"{mean:.3f}±{sd or 0:.3f}"


def markdown(rows: list[dict], columns: list[str] | None = None) -> str:
    """A table; doubles with three places, nothing as a dash."""
    columns = columns or list(rows[0] if rows else [])
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join("| " + " | ".join(cells) + " |" for cells in [columns, ["---"] * len(columns), *[[show(r.get(c)) for c in columns] for r in rows]])


def confusion_markdown(rows: list[dict], classes: list[str]) -> str:
    """Rows (t, p, n) as a matrix, truth down, prediction across."""
    n = {(r["t"], r["p"]): r["n"] for r in rows}
    return markdown([{"true \\ predicted": t} | {p: n.get((t, p), 0) for p in classes} for t in classes])


def to_json(rows: list[dict]) -> str:
    return json.dumps(rows, indent=2, ensure_ascii=False, default=str)


def _svg(width: int, height: int, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="11">' + "".join(parts) + "</svg>"


def write_json(rows: list[dict], path: str) -> None:
    """The rows as a JSON file that appears when it is whole."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(to_json(rows))
    os.replace(f"{path}.tmp", path)


class Log:
    """A markdown report that grows line by line and may be told aloud."""

    def __init__(self, tell: Callable[[str], None] | None = None):
        self.lines, self.tell = [], tell

    def say(self, text: str = "") -> None:
        self.lines.append(text)
        if self.tell:
            self.tell(text)

    def text(self) -> str:
        return "\n".join(self.lines) + "\n"


def prompt_results(rows: list[dict]) -> str:
    """Scores by model and prompt as a section for each model, prompts in order."""
    log = Log()
    for model in sorted({r["model"] for r in rows}):
        log.say(f"## {model}\n")
        own = sorted((r for r in rows if r["model"] == model), key=lambda r: r["prompt"])
        log.say(markdown(own, ["prompt", "accuracy", "macro_f1", "mcc", "consistency", "n_pairs"]) + "\n")
    return log.text()


def shortened(label: str, most: int = 12) -> str:
    """A label without what stands in brackets, cut with an ellipsis."""
    label = re.sub(r"\s*\([^)]*\)", "", label)
    return label if len(label) <= most else label[: most - 1] + "…"


COLOURS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377")


def bar_chart(rows: list[dict], label: str, value: str | list[str]) -> str:
    """A group of bars per row, one for each value, from 0 to 1."""
    values = [value] if isinstance(value, str) else value
    step, parts = 20 + 20 * max(2, len(values)), []
    for k, r in enumerate(rows):
        for j, v in enumerate(values):
            h, x = 160 * max(0.0, min(1.0, r[v] or 0.0)), 20 + step * k + 20 * j * (2 if len(values) == 1 else 1)
            parts.append(f'<rect x="{x}" y="{180 - h:.1f}" width="{40 if len(values) == 1 else 18}" height="{h:.1f}" fill="{COLOURS[j % len(COLOURS)]}"/>')
        parts.append(f'<text x="{20 + step * k}" y="195">{escape(shortened(str(r[label])))}</text>')
    if len(values) > 1:
        parts += [f'<text x="{20 + 110 * j}" y="12" fill="{COLOURS[j % len(COLOURS)]}">{escape(v)}</text>' for j, v in enumerate(values)]
    return _svg(step * max(1, len(rows)) + 20, 205, parts)


def consistency_chart(rows: list[dict]) -> str:
    """Accuracy beside the consistency of pairs for each model."""
    return bar_chart(rows, "model", ["accuracy_mean", "consistency"])


def gradient_chart(rows: list[dict], scores: list[dict], name: str = "prompted models (least)") -> str:
    """Consistency of the trained models in ascending order, and the least one of the prompted models' scores."""
    known = [r["consistency"] for r in scores if r["consistency"] is not None]
    bars = sorted(({"model": r["model"], "consistency": r["consistency"]} for r in rows if r["consistency"] is not None), key=lambda r: r["consistency"])
    return bar_chart(bars + ([{"model": name, "consistency": min(known)}] if known else []), "model", "consistency")


def heatmap(rows: list[dict], classes: list[str]) -> str:
    """A confusion matrix with shaded cells."""
    n = {(r["t"], r["p"]): r["n"] for r in rows}
    most = max([1, *n.values()])
    cell = lambda i, j, v: f'<rect x="{80 + 70 * j}" y="{20 + 40 * i}" width="70" height="40" fill="#4477aa" fill-opacity="{v / most:.3f}" stroke="#ccc"/><text x="{105 + 70 * j}" y="{45 + 40 * i}">{v}</text>'
    return _svg(100 + 70 * len(classes), 40 + 40 * len(classes), [cell(i, j, n.get((t, p), 0)) for i, t in enumerate(classes) for j, p in enumerate(classes)] + [f'<text x="5" y="{45 + 40 * i}">{escape(t)}</text>' for i, t in enumerate(classes)])


def line_chart(rows: list[dict], x: str, mean: str, sd: str) -> str:
    """A line with a band of one deviation, both axes from 0 to 1."""
    at = lambda a, b: f"{40 + 300 * a:.1f},{180 - 160 * max(0.0, min(1.0, b)):.1f}"
    rows = sorted((r for r in rows if r[mean] is not None), key=lambda r: r[x])
    band = [at(r[x], r[mean] + r[sd]) for r in rows] + [at(r[x], r[mean] - r[sd]) for r in reversed(rows)]
    return _svg(360, 200, [f'<polygon points="{" ".join(band)}" fill="#4477aa" fill-opacity="0.2"/>', f'<polyline points="{" ".join(at(r[x], r[mean]) for r in rows)}" fill="none" stroke="#4477aa"/>'])
