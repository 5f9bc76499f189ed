"""Raster warps through a mesh, for projections that bend both axes.

A target tile is cut into quads whose corners are projected exactly; inside a quad, positions are interpolated. A quad is
divided as long as the middle of it or of one of its sides lies further than a bound from where the projection puts
it. Every target tile then meets the source tiles under its quads, one pair at a time: a pair gives weighted sums for
the cells it reaches, and these add up, so no mosaic of source tiles is ever one row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions.arrays import arrays, by_batch, lists, rasters
from tilespark.functions.tilemath import Grid

#: x and y of the target's system to x and y of the source's, as arrays; not finite where there is no such place.
Projection = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
QUAD = "c0 int, r0 int, c1 int, r1 int, sx array<double>, sy array<double>"


def mesh_quads(place: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, most_error: float, start: int = 64) -> tuple[np.ndarray, ...]:
    """``box`` (columns and rows from and to), and ``x``, ``y`` of the corners nw, ne, sw, se of the quads of one tile.

    ``place`` maps columns and rows, as fractions from the tile's corner, to source cells. Quads begin ``start`` wide and end at one
    cell; those of one cell with a corner that has no place are left out.
    """
    edges = np.arange(0, size, start)
    c0, r0 = (a.ravel() for a in np.meshgrid(edges, edges))
    todo = np.stack([c0, r0, np.minimum(c0 + start, size), np.minimum(r0 + start, size)], 1)
    boxes, xs, ys = [], [], []
    while len(todo):
        left, top, right, bottom = todo.T.astype(float)
        middle, centre = (left + right) / 2, (top + bottom) / 2
        x, y = place(np.stack([left, right, left, right, middle, middle, middle, left, right]), np.stack([top, top, bottom, bottom, centre, top, bottom, centre, centre]))
        known = np.isfinite(x).all(0) & np.isfinite(y).all(0)

        def error(v: np.ndarray) -> np.ndarray:
            nw, ne, sw, se = v[:4]
            return np.abs(np.stack([(nw + ne + sw + se) / 4, (nw + ne) / 2, (sw + se) / 2, (nw + sw) / 2, (ne + se) / 2]) - v[4:])

        with np.errstate(invalid="ignore"):
            straight = known & (np.maximum(error(x), error(y)).max(0) <= most_error)
        single = (todo[:, 2] - todo[:, 0] <= 1) & (todo[:, 3] - todo[:, 1] <= 1)
        done = straight | (single & np.isfinite(x[:4]).all(0) & np.isfinite(y[:4]).all(0))
        boxes.append(todo[done])
        xs.append(x[:4, done].T)
        ys.append(y[:4, done].T)
        c0, r0, c1, r1 = todo[~done & ~single].T
        cm, rm = np.maximum((c0 + c1) // 2, c0 + 1), np.maximum((r0 + r1) // 2, r0 + 1)
        parts = np.concatenate([np.stack(q, 1) for q in ((c0, r0, cm, rm), (cm, r0, c1, rm), (c0, rm, cm, r1), (cm, rm, c1, r1))])
        todo = parts[(parts[:, 0] < parts[:, 2]) & (parts[:, 1] < parts[:, 3])]
    return np.concatenate(boxes), np.concatenate(xs), np.concatenate(ys)


def target_meshes(targets: DataFrame, dst: Grid, src: Grid, src_level: int, project: Projection, most_error: float = 0.5) -> DataFrame:
    """``z, x, y, tx, ty, quads``: each target tile with each source tile (x, y) that some of its quads may need, and those quads.

    ``most_error`` is in source cells. Tiles that lie nowhere in the source's system are left out.
    """
    size, res = dst.tile_size, src.resolutions[src_level]
    box = dst.tile_bbox(F.col("x"), F.col("y"), F.col("z"))
    placed = targets.select("z", "x", "y", box.alias("_b")).select("z", "x", "y", "_b.*")
    left, top = src.bbox[0], src.bbox[3]
    last = [n - 1 for n in src.size(src_level)]

    def cut(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        at, tx, ty, quads = [], [], [], []
        for i, (minx, maxx, maxy) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("minx", "maxx", "maxy")), strict=True)):
            step = (maxx - minx) / size

            def place(c, r, minx=minx, maxy=maxy, step=step):
                x, y = project(minx + c * step, maxy - r * step)
                return (x - left) / res, (top - y) / res

            boxes, sx, sy = mesh_quads(place, size, most_error)
            # source cells that interpolation inside a quad may touch
            lo = [np.clip((np.floor(v.min(1) - 1) // src.tile_size), 0, n).astype(int) for v, n in ((sx, last[0]), (sy, last[1]))]
            hi = [np.clip((np.floor(v.max(1) + 1) // src.tile_size), -1, n).astype(int) for v, n in ((sx, last[0]), (sy, last[1]))]
            needed: dict[tuple[int, int], list[int]] = {}
            for q in range(len(boxes)):
                for a in range(lo[0][q], hi[0][q] + 1):
                    for b in range(lo[1][q], hi[1][q] + 1):
                        needed.setdefault((a, b), []).append(q)
            for (a, b), which in needed.items():
                at.append(i)
                tx.append(a)
                ty.append(b)
                quads.append([{"c0": int(boxes[q, 0]), "r0": int(boxes[q, 1]), "c1": int(boxes[q, 2]), "r1": int(boxes[q, 3]),
                               "sx": sx[q].tolist(), "sy": sy[q].tolist()} for q in which])
        kind = pa.list_(pa.struct([*((c, pa.int32()) for c in ("c0", "r0", "c1", "r1")), ("sx", pa.list_(pa.float64())), ("sy", pa.list_(pa.float64()))]))
        return np.array(at, np.int64), {"tx": pa.array(tx, pa.int64()), "ty": pa.array(ty, pa.int64()), "quads": pa.array(quads, kind)}

    return by_batch(placed, cut, placed.select("z", "x", "y").schema.fields, f"tx long, ty long, quads array<struct<{QUAD.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")


def _positions(quad: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns and rows of a quad's cells and where their centres lie in the source."""
    cols, rows = np.arange(quad["c0"], quad["c1"]), np.arange(quad["r0"], quad["r1"])
    u, v = ((cols + 0.5 - quad["c0"]) / (quad["c1"] - quad["c0"]))[None, :], ((rows + 0.5 - quad["r0"]) / (quad["r1"] - quad["r0"]))[:, None]
    x, y = ((nw * (1 - u) + ne * u) * (1 - v) + (sw * (1 - u) + se * u) * v for nw, ne, sw, se in (quad["sx"], quad["sy"]))
    return np.repeat(cols[None, :], len(rows), 0).ravel(), np.repeat(rows, len(cols)), x.ravel(), y.ravel()


def mesh_warp(targets: DataFrame, sources: DataFrame, dst: Grid, src: Grid, src_level: int, project: Projection, method: str = "nearest",
              nodata: float = -9999.0, most_error: float = 0.5) -> DataFrame:
    """``z, x, y, vals`` of the target tiles that reach any source tile, north first; cells that reach no valid source cell are null.

    ``nearest`` takes the source cell that holds a cell's centre, ``bilinear`` the mean of the four cells around it, weighed by
    distance, without those that are absent or nodata. ``sources``: x, y, vals of one source level, counted from the north.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"no method {method}")
    size, side = dst.tile_size, src.tile_size
    pairs = target_meshes(targets, dst, src, src_level, project, most_error)
    held = sources.select(F.col("x").alias("tx"), F.col("y").alias("ty"), "vals")

    def sums(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        cells, total, weight = [], [], []
        for quads, vals, tx, ty in zip(batch.column("quads").to_pylist(), arrays(batch.column("vals")), batch.column("tx").to_pylist(), batch.column("ty").to_pylist(), strict=True):
            grid = vals.reshape(side, side)
            num, den = np.zeros(size * size), np.zeros(size * size)
            for quad in quads:
                c, r, x, y = _positions(quad)
                if method == "nearest":
                    spots = [(np.floor(x), np.floor(y), np.ones(len(x)))]
                else:
                    x0, y0 = np.floor(x - 0.5), np.floor(y - 0.5)
                    fx, fy = x - 0.5 - x0, y - 0.5 - y0
                    spots = [(x0 + i, y0 + j, np.where(i, fx, 1 - fx) * np.where(j, fy, 1 - fy)) for i in (0, 1) for j in (0, 1)]
                for sx, sy, w in spots:
                    i, j = sx - tx * side, sy - ty * side
                    here = (i >= 0) & (i < side) & (j >= 0) & (j < side) & (w > 0)
                    v = grid[j[here].astype(int), i[here].astype(int)]
                    good = (v != nodata) & ~np.isnan(v)
                    at = (r[here] * size + c[here])[good]
                    num[at] += w[here][good] * v[good]
                    den[at] += w[here][good]
            some = np.flatnonzero(den)
            cells.append(some)
            total.append(num[some])
            weight.append(den[some])
        offsets = pa.array(np.cumsum([0, *map(len, cells)]), pa.int32())
        flat = np.concatenate(cells) if cells else np.empty(0)
        return np.arange(len(cells)), {"cells": pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))), "total": rasters(total), "weight": rasters(weight)}

    joined = pairs.join(held, ["tx", "ty"])
    key = ["z", "x", "y"]
    parts = by_batch(joined, sums, joined.select(*key).schema.fields, "cells array<int>, total array<double>, weight array<double>")
    # together these hold each target cell once, or a few times at the source tiles' borders
    listed = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("cells", "total", "weight"))).alias("_parts"))
    whole = listed.select(*key, *[F.flatten(F.col(f"_parts.{c}")).alias(c) for c in ("cells", "total", "weight")])

    def put(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        out = []
        for cells, total, weight in zip(lists(batch.column("cells")), arrays(batch.column("total")), arrays(batch.column("weight")), strict=True):
            at = cells.to_numpy(zero_copy_only=False).astype(np.int64)
            num, den = np.bincount(at, total, size * size), np.bincount(at, weight, size * size)
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(np.where(den > 0, num / den, np.nan))
        return np.arange(len(out)), {"vals": rasters(out)}

    return by_batch(whole, put, whole.select(*key).schema.fields, "vals array<double>")
