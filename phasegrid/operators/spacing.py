"""Points of a path that lie apart from the last point kept before them.

Whether a point stays depends on the decision before it, so a path is a fold.  To fold a long path
in parts, a block of it is summarised by what it does to the point kept before it: the first point
of the block that is far from that one is kept, and from there on everything is settled.  Only
points that widen the bounding box of the block's beginning can be that first point, so the summary
is a short list of growing boxes, each with the last point kept if its bounds are what is too far.
Such summaries are chained over the blocks of a path (a row a block), and then each block is folded
by itself from the point it inherits.  Only blocks with one after them are summarised, and blocks lie one
after another in the batches of a task, where they are folded side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.functions.scan import by_shuffle

GRID = 0.1  # of recorded locations
ON_GRID = 1e-4

_BOX = ("lo_x", "hi_x", "lo_y", "hi_y")
_LISTS = (*_BOX, "exit_x", "exit_y")
# Blocks that are folded one by one when so few are left that have more points.
FEW = 16


def _first_far(x: np.ndarray, y: np.ndarray, start: int, at: tuple[float, float], apart: float) -> int:
    """First index from ``start`` whose point is far from ``at``; the length where there is none."""
    size = 16
    while start < len(x):
        end = start + size
        far = (np.abs(x[start:end] - at[0]) > apart) | (np.abs(y[start:end] - at[1]) > apart)
        hit = int(far.argmax())
        if far[hit]:
            return start + hit
        start, size = end, size * 2
    return len(x)


def _starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """First rows of the runs of equal values in ``names``."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for name in names:
        column = table[name].combine_chunks()
        code = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _whole_blocks(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole runs, with the first row of each and the end of the last."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if len(table) == 0:
            continue
        starts = _starts(table, names)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1])
    if held is not None:
        yield held, np.array([0, len(held)])


def folded(x: np.ndarray, y: np.ndarray, cuts: np.ndarray, before: np.ndarray, fresh: np.ndarray, apart: float) -> np.ndarray:
    """Which points stay, of blocks between ``cuts``; ``before``: the points kept before them (two rows),
    ``fresh``: blocks that none was kept before.

    The blocks advance together, a point each; the last few long ones one by one.
    """
    stays = np.zeros(len(x), bool)
    size = np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    start, size, none = cuts[:-1][order], size[order], fresh[order].copy()
    at_x, at_y = before[0][order].astype(float), before[1][order].astype(float)
    step, open_ = 0, len(order)
    while True:
        open_ = int(np.searchsorted(-size[:open_], -step, "left"))  # blocks of more points than that
        if open_ <= FEW:
            break
        at = start[:open_] + step
        px, py = x[at], y[at]
        far = none[:open_] | (np.abs(px - at_x[:open_]) > apart) | (np.abs(py - at_y[:open_]) > apart)
        stays[at] = far
        at_x[:open_], at_y[:open_] = np.where(far, px, at_x[:open_]), np.where(far, py, at_y[:open_])
        none[:open_] = False
        step += 1
    for i in range(open_):
        lo, hi = start[i] + step, start[i] + size[i]
        px, py = x[lo:hi], y[lo:hi]
        at = 0 if none[i] else _first_far(px, py, 0, (at_x[i], at_y[i]), apart)
        while at < len(px):
            stays[lo + at] = True
            at = _first_far(px, py, at + 1, (px[at], py[at]), apart)
    return stays


def block_effect(x: np.ndarray, y: np.ndarray, apart: float) -> dict[str, list[float]]:
    """Growing boxes of a block's beginning and the last point kept if the box is too far."""
    lo_x, hi_x = np.minimum.accumulate(x), np.maximum.accumulate(x)
    lo_y, hi_y = np.minimum.accumulate(y), np.maximum.accumulate(y)
    wider = np.zeros(len(x), bool)
    wider[0] = True
    for side in (lo_x, hi_x, lo_y, hi_y):
        wider[1:] |= side[1:] != side[:-1]
    # A point near all before it exists only while they fit into one box of twice the distance.
    fits = np.ones(len(x), bool)
    limit = 2 * apart * (1 + 1e-9)
    fits[1:] = (hi_x[:-1] - lo_x[:-1] <= limit) & (hi_y[:-1] - lo_y[:-1] <= limit)
    ends: dict[int, int] = {}
    out: dict[str, list[float]] = {name: [] for name in _LISTS}
    last = None
    for i in np.flatnonzero(wider & fits).tolist():
        walked, at = [], i
        while at not in ends:
            walked.append(at)
            following = _first_far(x, y, at + 1, (x[at], y[at]), apart)
            if following == len(x):
                ends[at] = at
            else:
                at = following
        ends.update(dict.fromkeys(walked, ends[at]))
        box = (lo_x[i], hi_x[i], lo_y[i], hi_y[i])
        if ends[i] == last:  # the same exit: one wider box tells both
            for name, side in zip(_BOX, box):
                out[name][-1] = float(side)
        else:
            last = ends[i]
            for name, value in zip(_LISTS, (*box, x[last], y[last])):
                out[name].append(float(value))
    return out


def after_block(at: tuple[float, float] | None, effect: dict[str, list[float]], apart: float) -> tuple[float, float]:
    """Last point kept after a block, from the one kept before it (None at the start of a path)."""
    for lo_x, hi_x, lo_y, hi_y, exit_x, exit_y in zip(*(effect[name] for name in _LISTS)):
        if at is None or any(
            abs(side - held) > apart for side, held in ((lo_x, at[0]), (hi_x, at[0]), (lo_y, at[1]), (hi_y, at[1]))
        ):
            return exit_x, exit_y
    return at


def kept_points(points: DataFrame, key: Sequence[str], apart: float) -> DataFrame:
    """Points (key, block, pos, x, y) more than ``apart`` in x or y from the last point kept.

    The first point of a path always stays.  ``pos`` orders a path and ``block`` cuts it in that
    order; no task holds more than one block, or one summary row for each block of a path.
    """
    keys = list(key)
    path = [*keys, "block"]
    points = points.select(*path, "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=path)
    ids, block = [points.schema[k] for k in keys], points.schema["block"]
    columns = points.columns

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_blocks(batches, path):
            x, y = table["x"].to_numpy(), table["y"].to_numpy()
            found = [block_effect(x[lo:hi], y[lo:hi], apart) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            head = table.select([*path, "next"]).take(pa.array(cuts[:-1]))
            for name in _LISTS:
                head = head.append_column(name, pa.array([f[name] for f in found], pa.list_(pa.float64())))
            yield from head.to_batches()

    def inherited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            left = []
            names = zip(*(rows[k].to_pylist() for k in keys)) if keys else [()] * len(rows)
            for key, effect in zip(names, rows.select(list(_LISTS)).to_pylist()):
                at = after_block(at if key == now else None, effect, apart)
                now = key
                left.append(at)
            out = rows.select([*keys, "next"]).rename_columns(path)
            for i, name in enumerate(("x", "y")):
                out = out.append_column(name, pa.array([h[i] for h in left], pa.float64()))
            yield from out.to_batches()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_blocks(batches, path):
            first = table.select(["entry", "x", "y"]).take(pa.array(cuts[:-1]))
            entered = first["entry"].to_numpy()
            before = np.stack([first["x"].to_numpy(), first["y"].to_numpy()])
            points = pc.invert(table["entry"])
            cuts = cuts - np.concatenate([[0], np.cumsum(entered)])
            table = table.filter(points).select(columns)
            stays = folded(table["x"].to_numpy(), table["y"].to_numpy(), cuts, before, ~entered, apart)
            yield from table.filter(pa.array(stays)).to_batches()

    lists = [T.StructField(name, T.ArrayType(T.DoubleType())) for name in _LISTS]
    entry = [T.StructField(name, T.DoubleType()) for name in ("x", "y")]
    later = Window.partitionBy(*keys).orderBy("block")  # a row a block
    chained = points.select(*path).distinct().withColumn("next", F.lead("block").over(later)).dropna(subset=["next"])
    following = T.StructField("next", block.dataType)
    summary = (
        points.join(by_shuffle(chained), path).select(*columns, "next").repartition(*path).sortWithinPartitions(*path, "pos")
        .mapInArrow(effects, T.StructType([*ids, block, following, *lists]))
    )
    carry = summary.repartition(*keys).sortWithinPartitions(*path).mapInArrow(inherited, T.StructType([*ids, block, *entry]))
    # The point kept before a block comes before its own; no join, whose skewed parts could split a block.
    entries = carry.withColumns({"pos": F.lit(None).cast(points.schema["pos"].dataType), "entry": F.lit(True)})
    rows = points.withColumn("entry", F.lit(False)).unionByName(entries)
    return rows.repartition(*path).sortWithinPartitions(*path, F.desc("entry"), "pos").mapInArrow(kept, points.schema)


def without_repeats(points: DataFrame, key: Sequence[str], apart: float) -> DataFrame:
    """``points`` for a comparison of neighbours: paths off the location grid keep spaced points only.

    On the grid two locations are equal or far apart, so that comparing with the point before is
    the same as with the last one kept, and the path needs no fold.
    """
    keys = list(key)

    def off(c: str):
        return F.abs(F.col(c) / GRID - F.rint(F.col(c) / GRID)) > ON_GRID / GRID

    rough = points.filter(off("x") | off("y")).select(*keys)
    if apart < GRID - 2 * ON_GRID and rough.isEmpty():
        return points
    rough = rough.distinct()
    # Found by block, so that a long path is not joined in one task.
    blocks = points.select(*keys, "block").distinct().join(by_shuffle(rough), keys, "left_semi")
    rough, at = by_shuffle(blocks), [*keys, "block"]
    smooth = points.join(rough, at, "left_anti").select(*keys, "block", "pos", "x", "y")
    return smooth.union(kept_points(points.join(rough, at, "left_semi"), keys, apart))
