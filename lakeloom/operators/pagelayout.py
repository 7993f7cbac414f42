"""Reading order and structure of placed text: gaps, columns, frames, breaks, marks, list numbers, overlaps
(P-19, P-26, W-06, W-10, W-14, W-24, F-13, F-35, F-46, J-17).

What depends on the row before is a window; what reads its own output is a function over one document, in Arrow batches.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as tx

#: Fixed values, in sizes of the smaller text: gaps that are a space and a new cell; and the share of lines alone on a side.
SPACE, CELL, ALONE = 0.18, 2.2, 0.25
#: A page's number, with words and dashes around it.
NUMBER_LINE = r"(?i)^([-–—]\s*)?(page|стр\.?|страница|s\.|p\.)?\s*[0-9]{1,4}(\s*(/|of|из|iz)\s*[0-9]{1,4})?\s*([-–—])?$"


def number_at_edge(text: Column, share: Column) -> Column:
    """A short line at the top or bottom tenth of a page that is only its number."""
    return (F.length(text) <= 24) & ((share < 0.10) | (share > 0.90)) & F.trim(text).rlike(NUMBER_LINE)


def number_alone(text: Column) -> Column:
    """A paragraph that is only a page's number."""
    return (F.length(text) <= 12) & F.trim(text).rlike(NUMBER_LINE)


def without_frames(boxes: DataFrame, row: str, width: str) -> DataFrame:
    """Boxes of a row without those that span nearly all of it, where two or more remain."""
    by = Window.partitionBy(row)
    inner = F.col(width) < 0.95 * F.max(width).over(by)
    marked = boxes.withColumn("__inner", inner)
    return marked.withColumn("__n", F.count_if("__inner").over(by)).where((F.col("__n") < 2) | F.col("__inner")).drop("__inner", "__n")


def _gap(order: Window, x0: str, x1: str, size: str) -> tuple[Column, Column]:
    """Distance to the run before, and the smaller of both sizes (10 where none is known)."""
    smaller = F.least(F.lag(size).over(order), F.col(size))
    return F.col(x0) - F.lag(x1).over(order), F.when(smaller > 0, smaller).otherwise(10.0)


def line_texts(runs: DataFrame, line: str, x0: str, x1: str, size: str, text: str) -> DataFrame:
    """``line`` and ``text``: the runs of a line joined, with the spaces that gaps stand for."""
    order = Window.partitionBy(line).orderBy(x0)
    gap, unit = _gap(order, x0, x1, size)
    spaced = (gap > unit * SPACE) & ~F.lag(text).over(order).endswith(" ") & ~F.col(text).startswith(" ")
    rows = runs.select(line, x0, F.concat(F.when(spaced, " ").otherwise(""), F.col(text)).alias("__t"))
    joined = rows.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(x0, "__t"))).alias("__r"))  # the runs of one line of a page
    return joined.select(line, tx.squeezed(F.array_join(F.transform("__r", lambda r: r["__t"]), "")).alias("text"))


def cells(runs: DataFrame, line: str, x0: str, x1: str, size: str) -> DataFrame:
    """``runs`` with ``cell``: a number that steps up where a run stands far from the one before."""
    order = Window.partitionBy(line).orderBy(x0)
    gap, unit = _gap(order, x0, x1, size)
    step = runs.withColumn("__s", F.when(gap > unit * CELL, 1).otherwise(0))
    return step.withColumn("cell", F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__s")


def in_columns(lines: DataFrame, page: str, at: str, left: str, right: str) -> DataFrame:
    """``page`` and ``columns``: whether lines stand alone on both sides of a gutter, often enough, and twice running on one."""
    side = F.when(F.col(left) & ~F.col(right), "left").when(F.col(right) & ~F.col(left), "right")
    order = Window.partitionBy(page).orderBy(at)
    rows = lines.select(page, at, side.alias("__side"))
    rows = rows.withColumn("__new", F.when(F.col("__side").eqNullSafe(F.lag("__side").over(order)), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(page, "__run").agg(F.any_value("__side").alias("__side"), F.count(F.lit(1)).alias("__n"))
    alone = lambda s: F.sum(F.when(F.col("__side") == s, F.col("__n")).otherwise(0))
    longest = F.max(F.when(F.col("__side").isNotNull(), F.col("__n")).otherwise(0))
    every = F.sum("__n")
    return runs.groupBy(page).agg(((alone("left") > 0) & (alone("right") > 0) & (longest >= 2) & (alone("left") + alone("right") >= every * ALONE)).alias("columns"))


def with_breaks(pieces: DataFrame, by: str, at: str, y: str, size: str, text: str) -> DataFrame:
    """``by`` and ``text``: pieces joined, on a new line where the baseline moves over half a size, a drop capital aside."""
    order = Window.partitionBy(by).orderBy(at)
    before = lambda c: F.lag(c).over(order)
    moved = F.abs(F.col(y) - before(y)) > F.greatest(F.lit(1.0), F.least(F.col(size), before(size)) * 0.5)
    capital = (before(size) >= F.col(size) * 1.5) & F.trim(before(text)).rlike(r"^\p{L}$")
    rows = pieces.select(by, at, F.concat(F.when(moved & ~capital, "\n").otherwise(""), F.col(text)).alias("__t"))
    joined = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, "__t"))).alias("__r"))  # the pieces of one element
    return joined.select(by, F.array_join(F.transform("__r", lambda r: r["__t"]), "").alias("text"))


def marked_spans(spans: DataFrame, by: str, at: str, text: str, bold: str, italic: str, strike: str) -> DataFrame:
    """``by`` and ``markdown``: neighbours of one formatting merged, marks around their words and spaces outside the marks."""
    order = Window.partitionBy(by).orderBy(at)
    look = F.concat_ws("", *[F.when(F.col(c), "1").otherwise("0") for c in (bold, italic, strike)])
    rows = spans.where(F.length(text) > 0).withColumn("__look", look)
    rows = rows.withColumn("__new", F.when(F.col("__look") == F.lag("__look").over(order), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(by, "__run", "__look").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, F.col(text).alias("t")))), lambda r: r["t"]), "").alias("__t"))
    mark = F.when(F.col("__look").startswith("11"), "***").when(F.col("__look").startswith("10"), "**").when(F.col("__look").startswith("01"), "*").when(F.col("__look") == "001", "~~").otherwise("")
    body = F.regexp_replace("__t", r"^\s+|\s+$", "")
    edge = lambda p: F.when(F.col("__t").rlike(p), " ").otherwise("")
    shown = F.when(body == "", " ").otherwise(F.concat(edge(r"^\s"), mark, tx.md_escape(F.regexp_replace(body, r"\s+", " ")), mark, edge(r"\s$")))
    parts = merged.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__run", shown.alias("s")))).alias("__r"))
    return parts.select(by, tx.squeezed(F.array_join(F.transform("__r", lambda r: r["s"]), "")).alias("markdown"))


def _numeral(n: int, kind: str) -> str:
    if kind in ("lowerLetter", "upperLetter"):
        out = chr(97 + (n - 1) % 26) * (1 + (n - 1) // 26) if n > 0 else ""
    elif kind in ("lowerRoman", "upperRoman"):
        out = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            out, n = out + sign * (n // value), n % value
    else:
        return f"{n:02d}" if kind == "decimalZero" else str(n)
    return out.upper() if kind.startswith("upper") else out


def list_labels(paragraphs: DataFrame, levels: dict, lists: dict) -> DataFrame:
    """``paragraphs`` (``doc``, ``pos``, ``list_id``, ``level``) with ``label``: the number that each shows, counted along its document.

    ``levels`` has for each abstract list and level the numeral's kind, the wording with ``%1`` for the first level's number and so
    on, the first number, and whether all numbers are decimal; ``lists`` has for each list its abstract list and the first numbers
    of its own, which count from the list's first paragraph on. A paragraph starts all deeper levels of its abstract list anew.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in paragraphs.schema)}, label string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        counts: dict = {}
        seen: set = set()
        labels = []
        for list_id, level in zip(rows["list_id"].tolist(), rows["level"].tolist(), strict=True):
            abstract, own = lists.get(list_id, (None, {}))
            of_list = levels.get(abstract, {})
            if level not in of_list:
                labels.append(None)
                continue
            at = counts.setdefault(abstract, {})
            if list_id not in seen:
                seen.add(list_id)
                at.update({k: first - 1 for k, first in own.items()})
            kind, wording, first, decimal = of_list[level]
            at[level] = at.get(level, first - 1) + 1
            counts[abstract] = {k: n for k, n in at.items() if k <= level}

            def shown(m: re.Match, of_list=of_list, at=counts[abstract], decimal=decimal) -> str:
                other = of_list.get(int(m[1]) - 1, ("decimal", "", 1, False))
                return _numeral(at.get(int(m[1]) - 1, other[2]), "decimal" if decimal else other[0])

            labels.append("•" if kind == "bullet" else re.sub(r"%(\d)", shown, wording) if kind != "none" else "")
        return rows.assign(label=labels)

    return paragraphs.groupBy("doc").applyInPandas(run, schema)


class _Cell:
    """Placed boxes whose left edges lie close enough that none is beside another's gap: sorted, apart by the margin.

    A run is boxes in turn each of which pushes any other box to the next, so a box that meets one goes below the run's end.
    """

    def __init__(self) -> None:
        self.tops: list[float] = []
        self.bottoms: list[float] = []
        self.lefts: list[float] = []
        self.heads: list[float] = []  # tops of the runs' first boxes
        self.ends: list[float] = []  # bottoms of their last
        self.low, self.high = math.inf, -math.inf

    def run_end(self, k: int) -> float:
        return self.ends[bisect_right(self.heads, self.tops[k]) - 1]

    def add(self, left: float, top: float, bottom: float, joined: Callable[[float, float, float], bool]) -> None:
        k = bisect_right(self.tops, top)
        r = bisect_right(self.heads, top)
        if 0 < k < len(self.tops) and (r == len(self.heads) or self.heads[r] > self.tops[k]):  # within a run: two of it
            self.heads.insert(r, self.tops[k])
            self.ends.insert(r - 1, self.bottoms[k - 1])
        up = k > 0 and joined(self.bottoms[k - 1], top, bottom)
        down = k < len(self.tops) and joined(bottom, self.tops[k], self.bottoms[k])
        if up and down:
            del self.heads[r], self.ends[r - 1]
        elif up:
            self.ends[r - 1] = bottom
        elif down:
            self.heads[r] = top
        else:
            self.heads.insert(r, top)
            self.ends.insert(r, bottom)
        for held, value in ((self.tops, top), (self.bottoms, bottom), (self.lefts, left)):
            held.insert(k, value)
        self.low, self.high = min(self.low, left), max(self.high, left)


class _Boxes:
    """Boxes of a network as they are placed; each goes below the first (by top, then bottom) that it overlaps until there is none.

    Left edges fall into cells of half the reach, so the boxes of a cell are all beside one another. A box passes a run of a cell at a
    bisection; it goes past boxes one by one where a cell is beside it in part, or where another cell's boxes lie within the run and the
    order of obstacles counts, as it does where the gap exceeds the margin.
    """

    def __init__(self, reach: float, margin: float, gap: float, least: float):
        self.reach, self.margin, self.gap, self.least = reach, margin, gap, least
        self.cells: dict[int, _Cell] = {}
        self.taken: dict[tuple[float, float], float] = {}  # down to where a box of this left edge and height found no place
        self.inverted: list[tuple[float, float, float]] = []  # boxes without an extent, margin and all

    def _joined(self, bottom: float, next_top: float, next_bottom: float) -> bool:
        return next_top < bottom + self.gap + self.least + self.margin and bottom + self.gap < next_bottom + self.margin

    def _first(self, cell: _Cell, x: float, y: float, limit: float) -> int:
        """The first box of a cell that is beside, ends below ``y`` and begins above ``limit``; -1 for none."""
        k = bisect_right(cell.bottoms, y, key=lambda bottom: bottom + self.margin)
        while k < len(cell.tops) and cell.tops[k] < limit:
            if abs(cell.lefts[k] - x) < self.reach:
                return k
            k += 1
        return -1

    def place(self, x: float, y: float, height: float) -> float:
        """Where the box's top comes to lie; boxes come in order of ``y``."""
        if not (self.reach > 0 and math.isfinite(x) and math.isfinite(y)) or math.isnan(height):
            return y  # overlaps nothing
        at = math.floor(x / self.reach * 2)
        near = [c for k in range(at - 3, at + 4) if (c := self.cells.get(k))]
        if self.gap == self.margin:  # then it is the first place there is
            y = max(y, self.taken.get((x, height), y))
        while True:
            limit = y + height + self.margin
            met = [(top, bottom, None, 0) for top, bottom, left in self.inverted if abs(left - x) < self.reach and y < bottom + self.margin and top < limit]
            for c in near:
                if (k := self._first(c, x, y, limit)) >= 0:
                    met.append((c.tops[k], c.bottoms[k], c, k))
            if not met:
                break
            _, bottom, cell, k = min(met, key=lambda m: m[:2])
            after = bottom + self.gap
            if cell and x - cell.low < self.reach and cell.high - x < self.reach:
                end = cell.run_end(k) + self.gap
                others = end + height + self.margin
                if self.gap == self.margin or not self.inverted and all(c is cell or self._first(c, x, y, others) < 0 for c in near):
                    after = end
            y = after
        if self.gap == self.margin:
            self.taken[x, height] = y
        if height + self.margin <= 0:
            self.inverted.append((y, y + height, x))
        elif math.isfinite(y):
            self.cells.setdefault(at, _Cell()).add(x, y, y + height, self._joined)
        return y


def settled(nodes: DataFrame, by: str, width: float, margin: float, gap: float) -> DataFrame:
    """``nodes`` (``id``, ``x``, ``y``, ``height``) with ``y`` pushed down, from the top, until no two of a network overlap.

    A network is settled in one task: about n log n steps where its boxes stand in columns and the gap is the margin. A wider gap, which
    leaves holes, and boxes of ever other ``x`` cost a step for each box that one is pushed past. The gap is no less than the margin, or a
    box would never come free.
    """
    if gap < margin:
        raise ValueError(f"a gap of {gap} is less than the margin of {margin}")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x", "id"]).reset_index(drop=True)
        boxes = _Boxes(width + margin, margin, gap, rows["height"].min())
        return rows.assign(y=[boxes.place(x, y, h) for x, y, h in zip(rows["x"].tolist(), rows["y"].tolist(), rows["height"].tolist(), strict=True)])

    return nodes.groupBy(by).applyInPandas(run, nodes.schema)
