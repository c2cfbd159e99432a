"""Pairs of overlapping boxes within the same image, or how many each box has, from boxes dealt by grid cells.

A cell's boxes are compared in blocks, by y and only as far down as an overlap of ``least`` can lie, first by a bound on
the union that needs no division; each pair that passes is then judged exactly, in the one cell it belongs to. Rows with
a null image, id or side meet nothing; ids are whole numbers, and equal ids are not a pair. Coordinates and areas are
computed as doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = ("x", "y", "w", "h")
ROWS, COLUMNS, OUT = 64, 1024, 1 << 17


def _placed(boxes: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Each box in every cell that it meets, a cell's rows in a row. A cell has twice the median sides of the boxes, so that
    most lie in few cells, and a crowded image is split by its cells."""
    boxes = boxes.select("image", "id", *SIDES).dropna()
    sides = boxes.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in ("w", "h")]).collect()[0]
    size = {"x": max(1, 2 * int(sides.w or 1)), "y": max(1, 2 * int(sides.h or 1))}
    cells = lambda at, side: F.sequence(F.floor(F.col(at) / size[at]), F.floor((F.col(at) + F.col(side) - 1) / size[at]))
    placed = boxes.withColumn("cx", F.explode(cells("x", "w"))).withColumn("cy", F.explode(cells("y", "h")))
    # the partitions are set, as pairs are many more than the boxes that adaptive planning counts
    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "image", "cx", "cy").sortWithinPartitions("image", "cx", "cy"), size


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, which may span batches."""
    held: list[pa.RecordBatch] = []
    same = lambda a, b: all(a.column(c)[-1] == b.column(c)[0] for c in ("image", "cx", "cy"))
    for b in batches:
        if not b.num_rows:
            continue
        if held and not same(held[-1], b):
            yield pa.Table.from_batches(held)
            held = []
        new = np.zeros(max(b.num_rows - 1, 0), bool)
        for c in ("image", "cx", "cy"):
            new |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for s, e in zip(at[:-1], at[1:], strict=True):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _meetings(cell: pa.Table, size: dict[str, int], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``i`` and ``j`` of the cell's pairs, that of the smaller id first, and their overlaps."""
    raw = [cell.column(c).to_numpy() for c in SIDES]
    whole = all(v.dtype.kind in "iu" for v in raw)
    order = np.argsort(raw[1], kind="stable")
    x, y, w, h = (v[order].astype(np.float64) for v in raw)
    ids = cell.column("id").to_numpy()[order]
    # a pair belongs to the cell in which its intersection begins
    cx, cy = np.floor(x / size["x"]), np.floor(y / size["y"])
    own_x, own_y = float(cell.column("cx")[0].as_py()), float(cell.column("cy")[0].as_py())
    x2, y2, area = x + w, y + h, w * h
    # the intersection is at least ``least`` of the upper box, so of its height
    reach = y + h * (1 - least) + 1e-6 * (1 + np.abs(y) + np.abs(h))
    # whole numbers of this size are exact in single precision, their products to 1e-7
    small = whole and max(float(np.abs(v).max()) for v in (x, y, x2, y2)) < 1 << 22
    kind, slack = (np.float32, 1e-5) if small else (np.float64, 1e-9)
    bound = area * (least / (1 + least)) * (1 - slack)
    fx, fy, fx2, fy2, fb = (v.astype(kind) for v in (x, y, x2, y2, bound))
    n, room = len(x), [np.empty(ROWS * COLUMNS, kind) for _ in range(3)]
    for i0 in range(0, n, ROWS):
        i1 = min(n, i0 + ROWS)
        end = int(np.searchsorted(y, reach[i0:i1].max(), "right"))
        ax, ay, ax2, ay2, ab = (v[i0:i1, None] for v in (fx, fy, fx2, fy2, fb))
        for j0 in range(i0, end, COLUMNS):
            j1 = min(end, j0 + COLUMNS)
            a, b, c = (r[: (i1 - i0) * (j1 - j0)].reshape(i1 - i0, j1 - j0) for r in room)
            np.minimum(ax2, fx2[j0:j1], out=a)
            np.maximum(ax, fx[j0:j1], out=b)
            np.subtract(a, b, out=a)
            np.maximum(a, 0, out=a)
            np.minimum(ay2, fy2[j0:j1], out=b)
            np.maximum(ay, fy[j0:j1], out=c)
            np.subtract(b, c, out=b)
            np.multiply(a, b, out=a)
            np.add(ab, fb[j0:j1], out=b)
            i, j = np.divmod(np.flatnonzero(a >= b), j1 - j0)
            i, j = i + i0, j + j0
            here = (i < j) & (np.maximum(cx[i], cx[j]) == own_x) & (np.maximum(cy[i], cy[j]) == own_y)
            i, j = i[here], j[here]
            wide, high = np.minimum(x2[i], x2[j]) - np.maximum(x[i], x[j]), np.minimum(y2[i], y2[j]) - np.maximum(y[i], y[j])
            inter = wide * high
            with np.errstate(divide="ignore", invalid="ignore"):
                iou = inter / (area[i] + area[j] - inter)
            good = (wide > 0) & (high > 0) & (iou >= least) & (ids[i] != ids[j])
            i, j, iou = i[good], j[good], iou[good]
            if len(i):
                first = ids[i] < ids[j]
                yield order[np.where(first, i, j)], order[np.where(first, j, i)], iou


def pairs(boxes: DataFrame, least: float) -> DataFrame:
    """``image``, ``id``, ``id2`` (the larger) and ``iou`` of the pairs of one image that overlap by ``least`` (above 0) or more.

    ``boxes`` has ``image``, ``id``, ``x``, ``y``, ``w``, ``h``."""
    placed, size = _placed(boxes)
    image = placed.schema["image"].dataType.simpleString()

    def run(batches):
        held, rows = [], 0
        for cell in _cells(batches):
            ids, own = cell.column("id").to_numpy(), cell.column("image")[0]
            for i, j, iou in _meetings(cell, size, least):
                held.append((pa.repeat(own, len(i)), ids[i], ids[j], iou))
                rows += len(i)
                if rows >= OUT:
                    yield _batch(held)
                    held, rows = [], 0
        if held:
            yield _batch(held)

    return placed.mapInArrow(run, f"image {image}, id long, id2 long, iou double")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    image, *rest = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(image), *[pa.array(np.concatenate(c)) for c in rest]], ["image", "id", "id2", "iou"])


def counted(boxes: DataFrame, above: float) -> DataFrame:
    """``image``, ``id`` and ``n``: of each box, the boxes of its image with a larger id that it overlaps by more than ``above`` (above 0); 0 gives no row."""
    placed, size = _placed(boxes)
    image = placed.schema["image"].dataType.simpleString()

    def run(batches):
        for cell in _cells(batches):
            n = np.zeros(cell.num_rows, np.int64)
            for i, _, iou in _meetings(cell, size, above):
                np.add.at(n, i[iou > above], 1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.repeat(cell.column("image")[0], len(at)), pa.array(cell.column("id").to_numpy()[at]), pa.array(n[at])], ["image", "id", "n"])

    return placed.mapInArrow(run, f"image {image}, id long, n long").groupBy("image", "id").agg(F.sum("n").alias("n"))
