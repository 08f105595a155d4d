"""Descent of new rows against a frozen map, region by region.

New rows never see each other, so a row can run alone as long as the part of the map's field that it needs is at hand. The
plane is cut into square regions; a task gets one region's rows (a crowded region is dealt over several tasks by hash) with
the field of the region and a margin around it, runs each row until its iterations are done or it leaves the
margin, and the rows that left are dealt again. Rows move little, so few rounds are needed; each advances every open row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trefoil.functions import layout as L
from trefoil.operators.cells import CellTree, ys
from trefoil.session import cut_lineage, written

TILE_ROWS = 1024
#: Width of a region and of its margin, in boxes of the grid: a task holds 96 x 96 boxes at most, and the smallest grids are one region.
REGION_BOXES, MARGIN_BOXES = 64, 16
#: Regions across the map when a tree gives the field, and their least width; half of it is the margin. The kernel's length is one, so
#: narrower regions would be left with every step; a map's width grows with its rows, so few rows lie in one of that width.
REGIONS, LEAST_WIDTH = 16, 4.0


@dataclass(frozen=True)
class GridField:
    """Potentials by box (see ``convolve``), which must be stored: every round reads them."""

    grid: L.Grid
    boxes: DataFrame
    dims: int

    @property
    def width(self) -> float:
        return self.grid.width * REGION_BOXES

    @property
    def margin(self) -> float:
        return self.grid.width * MARGIN_BOXES

    @property
    def origin(self) -> tuple[float, ...]:
        return self.grid.low

    @property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Places beyond the grid count as its edge."""
        return np.array(self.grid.low), np.array(self.grid.low) + np.array(self.grid.boxes) * self.grid.width

    def region(self, places: list[Column]) -> list[Column]:
        """Rows beyond the grid belong to its outermost boxes."""
        out = []
        for place, low, boxes in zip(places, self.origin, self.grid.boxes):
            box = F.greatest(F.lit(0.0), F.least(F.floor((place - F.lit(float(low))) / F.lit(self.grid.width)), F.lit(boxes - 1.0)))
            out.append(F.floor(box / REGION_BOXES).cast("long"))
        return out

    def parts(self, regions: DataFrame) -> DataFrame:
        """``r0.., box, phi`` for each of the ``regions``."""
        out = self.boxes
        for c in range(self.dims):
            box = F.col("box")[c]
            out = out.withColumn(f"r{c}", F.explode(F.sequence(
                F.floor((box - MARGIN_BOXES) / REGION_BOXES).cast("long"), F.floor((box + MARGIN_BOXES) / REGION_BOXES).cast("long"))))
        return out.join(regions, ys(self.dims, "r"), "left_semi")

    def sampler(self):
        grid, dims = self.grid, self.dims

        def make(part: pd.DataFrame, region: np.ndarray):
            first = np.maximum(region * REGION_BOXES - MARGIN_BOXES, 0)
            last = np.minimum((region + 1) * REGION_BOXES + MARGIN_BOXES, np.array(grid.boxes)) - 1
            shape = last - first + 1
            phi = np.zeros((*shape, (dims + 2) * grid.points ** dims))
            at = np.stack(part["box"].to_numpy()) - first
            phi[tuple(at.T)] = np.stack(part["phi"].to_numpy())
            local = L.Grid(tuple(np.array(grid.low) + first * grid.width), tuple(int(s) for s in shape), grid.width, grid.points)

            def sample(y):
                got = L.weigh_nodes(local, phi[tuple(L.box_of(local, y).T)], y)
                return got[:, dims + 1], y * got[:, :1] - got[:, 1: dims + 1]

            return sample

        return make


@dataclass(frozen=True)
class TreeField:
    """The map's cell tree."""

    tree: CellTree
    theta: float
    dof: float

    @property
    def dims(self) -> int:
        return self.tree.dims

    @property
    def width(self) -> float:
        return max(self.tree.side / REGIONS, LEAST_WIDTH)

    @property
    def margin(self) -> float:
        return self.width / 2

    @property
    def origin(self) -> tuple[float, ...]:
        return self.tree.low

    @property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(self.dims, -np.inf), np.full(self.dims, np.inf)

    def region(self, places: list[Column]) -> list[Column]:
        return [F.floor((p - F.lit(float(low))) / F.lit(self.width)).cast("long") for p, low in zip(places, self.origin)]

    def parts(self, regions: DataFrame) -> DataFrame:
        """``r0.., parent, name, ..`` of the cells that a place in each region's reach may open."""
        keys = ys(self.dims, "r")
        edge = {}
        for c, (key, low) in enumerate(zip(keys, self.origin)):
            edge[f"lo{c}"] = F.lit(float(low)) + F.col(key) * self.width - self.margin
            edge[f"hi{c}"] = F.lit(float(low)) + (F.col(key) + 1) * self.width + self.margin
        boxes = cut_lineage(regions.withColumns(edge).withColumn("tile", F.xxhash64(*keys)))
        return self.tree.essential(boxes, self.theta).join(boxes.select("tile", *keys), "tile")

    def sampler(self):
        part, theta, dof = self.tree.part, self.theta, self.dof

        def make(rows: pd.DataFrame, region: np.ndarray):
            cells = part(rows)
            return lambda y: L.walk_cells(cells, y, theta, dof)

        return make


def layout_columns(dims: int) -> list[str]:
    return ["id", *[c for k in "yug" for c in ys(dims, k)]]


def place(layout: DataFrame, source: GridField | TreeField, plan: L.NewRows, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``layout(id, y.., u.., g.., weights, places)`` after ``plan.n_iter`` steps, with ``z``, the similarity sum of each row at
    its last place. ``weights`` and ``places`` (one after the other) are a row's links to the map."""
    dims, keys = source.dims, ys(source.dims, "r")
    columns = [*layout_columns(dims), "weights", "places"]
    kinds = ", ".join(["id long", *[f"{c} double" for c in columns[1:-2]], "weights array<double>", "places array<double>"])
    kinds += ", done long, z double"
    make, origin, width, margin, ends = source.sampler(), np.array(source.origin), source.width, source.margin, source.ends
    names = columns + ["done", "z"]

    def run(mine: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):  # the hash left this piece without rows
            return pd.DataFrame(columns=names)
        region = mine[keys].iloc[0].to_numpy(np.int64)
        low, high = origin + region * width - margin, origin + (region + 1) * width + margin
        sizes = mine["weights"].str.len().to_numpy(np.int64)
        fill = np.arange(max(int(sizes.max()), 1))[None] < sizes[:, None]
        p, refs = np.zeros(fill.shape), np.zeros((*fill.shape, dims))
        p[fill] = np.concatenate(mine["weights"].to_list())
        refs[fill] = np.concatenate(mine["places"].to_list()).reshape(-1, dims)
        sample = make(part, region)

        def inside(at: np.ndarray) -> np.ndarray:
            at = np.clip(at, *ends)
            return ((at >= low) & (at <= high)).all(1)

        y, u, g, done = L.descend_rows(
            *(mine[ys(dims, k)].to_numpy(float) for k in "yug"), p, refs, sample, plan, mine["done"].to_numpy(np.int64),
            inside,
        )
        out = mine[["id"]].assign(**{f"{k}{c}": v[:, c] for k, v in (("y", y), ("u", u), ("g", g)) for c in range(dims)})
        # A row that left with its last step is dealt once more, for its sum.
        z = np.where(inside(y), sample(y)[0], np.nan)
        return out.assign(weights=mine["weights"], places=mine["places"], done=done, z=z)[names]

    state = layout.select(*columns, F.lit(0).cast("long").alias("done"), F.lit(0.0).alias("z"))
    finished = []
    while True:
        here = dict(zip(keys, source.region([F.col(c) for c in ys(dims)])))
        rows = state.withColumns(here)
        regions = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).alias("pieces"))
        regions = cut_lineage(regions)
        rows = rows.join(regions, keys).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).drop("pieces")
        parts = source.parts(regions.select(*keys)).join(regions, keys).withColumn(
            "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
        group = [*keys, "piece"]
        moved = written(rows.groupBy(*group).cogroup(parts.groupBy(*group)).applyInPandas(run, kinds))
        over = (F.col("done") >= plan.n_iter) & F.col("z").isNotNull() & ~F.isnan("z")
        finished.append(moved.filter(over).drop("done"))
        state = moved.filter(~over)
        if state.isEmpty():
            return reduce(DataFrame.unionByName, finished)
