"""Charts of small results as SVG text: lines, bands, bars and steps, without a plotting library."""

from __future__ import annotations

from html import escape

#: Width, height and margins (left, top, right, bottom) of a chart.
SIZE, MARGIN = (760, 380), (64, 34, 190, 48)
#: Colours that stay apart in print and for colour-blind readers.
COLOURS = ("#1b6ca8", "#d1651c", "#3a8f4d", "#8a4fa3", "#555555", "#b8860b", "#c2396b", "#2a9d9d")


def ticks(lo: float, hi: float, n: int = 6) -> list[float]:
    """Round numbers from lo to hi, about n."""
    if not hi > lo:
        return [lo]
    raw = (hi - lo) / n
    power = 10.0 ** len(str(int(raw))) / 10 if raw >= 1 else 1.0
    while power > raw:
        power /= 10
    step = next(k * power for k in (1, 2, 5, 10) if k * power >= raw)
    first = -(-lo // step)
    return [round(k * step, 10) for k in range(int(first), int(hi // step) + 1)]


class Chart:
    """Collects shapes in data coordinates; ``svg()`` draws axes, shapes and legend."""

    def __init__(self, title: str, x_label: str, y_label: str, x: tuple[float, float], y: tuple[float, float]):
        self.title, self.labels, self.x, self.y = title, (x_label, y_label), x, y
        self.shapes: list[str] = []
        self.y_axis = True
        self.legend: list[tuple[str, str]] = []
        self.x_ticks: list[tuple[float, str]] = [(t, f"{t:g}") for t in ticks(*x)]

    def at(self, x: float, y: float) -> tuple[float, float]:
        (w, h), (a, b, c, d) = SIZE, MARGIN
        fx = (x - self.x[0]) / ((self.x[1] - self.x[0]) or 1)
        fy = (y - self.y[0]) / ((self.y[1] - self.y[0]) or 1)
        return round(a + fx * (w - a - c), 2), round(h - d - fy * (h - b - d), 2)

    def _points(self, xs, ys) -> str:
        return " ".join("{},{}".format(*self.at(x, y)) for x, y in zip(xs, ys) if y is not None)

    def line(self, xs, ys, colour: str, name: str | None = None) -> None:
        self.shapes.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{self._points(xs, ys)}"/>')
        self._name(name, colour)

    def band(self, xs, lo, hi, colour: str, name: str | None = None) -> None:
        there = [(x, a, b) for x, a, b in zip(xs, lo, hi) if a is not None and b is not None]
        ring = [(x, a) for x, a, _ in there] + [(x, b) for x, _, b in reversed(there)]
        self.shapes.append(f'<polygon fill="{colour}" fill-opacity="0.15" points="{self._points(*zip(*ring)) if ring else ""}"/>')
        self._name(name, colour)

    def box(self, x0: float, x1: float, y0: float, y1: float, colour: str, name: str | None = None) -> None:
        (a, b), (c, d) = self.at(x0, max(y0, y1)), self.at(x1, min(y0, y1))
        self.shapes.append(f'<rect x="{a}" y="{b}" width="{round(c - a, 2)}" height="{round(d - b, 2)}" fill="{colour}"/>')
        self._name(name, colour)

    def _name(self, name: str | None, colour: str) -> None:
        if name and (name, colour) not in self.legend:
            self.legend.append((name, colour))

    def svg(self) -> str:
        (w, h), (a, b, c, d) = SIZE, MARGIN
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="12">', f'<rect width="{w}" height="{h}" fill="white"/>']
        out.append(f'<text x="{a}" y="20" font-size="14">{escape(self.title)}</text>')
        for t in ticks(*self.y) if self.y_axis else ():
            x, y = self.at(self.x[0], t)
            out.append(f'<line x1="{a}" y1="{y}" x2="{w - c}" y2="{y}" stroke="#dddddd"/><text x="{a - 6}" y="{y + 4}" text-anchor="end">{t:g}</text>')
        for t, text in self.x_ticks:
            x, y = self.at(t, self.y[0])
            out.append(f'<text x="{x}" y="{h - d + 16}" text-anchor="middle">{escape(text)}</text>')
        out.append(f'<text x="{(a + w - c) / 2}" y="{h - 10}" text-anchor="middle">{escape(self.labels[0])}</text>')
        out.append(f'<text transform="translate(14,{(b + h - d) / 2}) rotate(-90)" text-anchor="middle">{escape(self.labels[1])}</text>')
        out += self.shapes
        for i, (name, colour) in enumerate(self.legend):
            out.append(f'<rect x="{w - c + 12}" y="{b + 18 * i}" width="12" height="12" fill="{colour}"/><text x="{w - c + 30}" y="{b + 18 * i + 11}">{escape(name)}</text>')
        return "\n".join([*out, "</svg>"]) + "\n"


def colours(models: list[str]) -> dict[str, str]:
    return {m: COLOURS[i % len(COLOURS)] for i, m in enumerate(models)}


def lines(rows: list, x: str, models: list[str], title: str, x_label: str, y: str = "mae", y_label: str = "MAE") -> str:
    """One line a model of rows (x, model, y)."""
    xs, ys = [r[x] for r in rows] or [0], [r[y] for r in rows if r[y] is not None] or [0]
    chart = Chart(title, x_label, y_label, (min(xs), max(xs)), (0, max(ys) * 1.05))
    for m, colour in colours(models).items():
        mine = sorted((r[x], r[y]) for r in rows if r["model"] == m)
        if mine:
            chart.line(*zip(*mine), colour, m)
    return chart.svg()


def grouped_bars(rows: list, group: str, order: list[str], models: list[str], title: str, y: str = "mae", y_label: str = "MAE") -> str:
    """Bars of each model side by side for each group, groups in the given order."""
    top = max([r[y] for r in rows if r[y] is not None] or [1])
    chart = Chart(title, group.replace("_", " "), y_label, (-0.5, len(order) - 0.5), (0, top * 1.05))
    chart.x_ticks = [(i, str(g)) for i, g in enumerate(order)]
    width = 0.8 / max(1, len(models))
    at = {(r[group], r["model"]): r[y] for r in rows}
    for k, (m, colour) in enumerate(colours(models).items()):
        for i, g in enumerate(order):
            if at.get((g, m)) is not None:
                chart.box(i - 0.4 + k * width, i - 0.4 + (k + 0.9) * width, 0, at[g, m], colour, m)
    return chart.svg()


def ranked(rows: list, name: str, value: str, title: str) -> str:
    """Horizontal bars, the first row on top."""
    rows, top = list(rows), max([r[value] for r in rows] or [1])
    chart = Chart(title, value.replace("_", " "), "", (0, top * 1.6), (-0.5, max(0.5, len(rows) - 0.5)))
    chart.y_axis = False
    for i, r in enumerate(reversed(rows)):
        chart.box(0, r[value], i - 0.3, i + 0.3, COLOURS[0])
        x, y = chart.at(r[value], i)
        chart.shapes.append(f'<text x="{x + 4}" y="{y + 4}">{escape(str(r[name]))}</text>')
    return chart.svg()


def steps(rows: list, models: list[str], title: str, width: float = 5) -> str:
    """Histograms as steps of rows (model, bin, density, median)."""
    top = max([r["density"] for r in rows] or [1])
    xs = [r["bin"] for r in rows] or [0]
    chart = Chart(title, "predicted minus actual", "density", (min(xs), max(xs) + width), (0, top * 1.05))
    for m, colour in colours(models).items():
        mine = sorted((r["bin"], r["density"], r["median"]) for r in rows if r["model"] == m)
        if mine:
            chart.line([x for b, _, _ in mine for x in (b, b + width)], [d for _, d, _ in mine for _ in (0, 1)], colour, f"{m} (median {mine[0][2]:+.1f})")
    return chart.svg()


def series(rows: list, time: str, actual: str, models: list[str], band: tuple[str, str] | None, title: str) -> str:
    """A week or so of actual values, forecasts and a band."""
    rows = sorted(rows, key=lambda r: r[time])
    xs = [(r[time] - rows[0][time]).total_seconds() / 86400 for r in rows]
    values = [r[c] for r in rows for c in (actual, *models, *(band or ())) if r[c] is not None] or [0]
    chart = Chart(title, "days", "value", (0, max(xs or [1])), (min(0, *values), max(values) * 1.05))
    if rows:
        chart.x_ticks = [(d, f"{rows[0][time].replace(hour=0, minute=0):%d %b}" if d == 0 else f"+{d}") for d in range(int(max(xs)) + 1)]
    if band:
        chart.band(xs, [r[band[0]] for r in rows], [r[band[1]] for r in rows], COLOURS[0], "interval")
    chart.line(xs, [r[actual] for r in rows], "#000000", "actual")
    for m, colour in colours(models).items():
        chart.line(xs, [r[m] for r in rows], colour, m)
    return chart.svg()
