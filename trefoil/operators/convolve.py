"""Interpolated repulsion on a grid that stays in Spark.

Charges of the rows are summed per grid node; the sums are convolved with the two kernels by a transform in two passes:
tasks transform node rows along the second axis and hand blocks of frequencies over, tasks that own a block transform along the
first axis, multiply by the kernel's transform and go back, and a last pass returns to node rows. What leaves is one row a
box with the potentials at its nodes; positions meet their box in a join. A task holds a few node rows or one
block of frequencies, whatever the number of positions, and no node passes through the driver.

Maps of one axis are a grid with a single node row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.functions import layout as L

#: Frequencies of the second axis in one block, and node rows transformed in one group.
BLOCK = 16
ROWS = 8


def ys(dims: int, prefix: str = "y") -> list[str]:
    return [f"{prefix}{c}" for c in range(dims)]


@dataclass(frozen=True)
class Plane:
    """A grid seen as node rows x node columns."""

    rows: int
    cols: int
    points: tuple[int, int]
    step: float

    @staticmethod
    def of(grid: L.Grid) -> "Plane":
        if len(grid.boxes) == 1:
            return Plane(1, grid.shape[0], (1, grid.points), grid.width / grid.points)
        return Plane(*grid.shape, (grid.points, grid.points), grid.width / grid.points)

    @property
    def blocks(self) -> int:
        return -(-(self.cols + 1) // BLOCK)

    def kernels(self, row: int, dof: float) -> np.ndarray:
        """Transforms along the second axis of (similarity, force) for nodes ``row`` rows apart."""
        far = np.minimum(np.arange(2 * self.cols), 2 * self.cols - np.arange(2 * self.cols)) * self.step
        return np.fft.rfft(np.stack(L.student(far * far + (row * self.step) ** 2, dof)))

    def across(self, charges: np.ndarray, kernels: np.ndarray) -> np.ndarray:
        """(terms, rows, width) and (2, rows + 1, width) to (terms + 1, rows, width): the force potential of every term,
        and the similarity potential of term 0."""
        if self.rows == 1:
            return np.concatenate([charges * kernels[1:, :1], charges[:1] * kernels[:1, :1]])
        whole = np.concatenate([kernels, kernels[:, -2:0:-1]], axis=1)
        spectrum, kernel = np.fft.fft(charges, 2 * self.rows, axis=1), np.fft.fft(whole, axis=1)
        both = np.concatenate([spectrum * kernel[1:], spectrum[:1] * kernel[:1]])
        return np.fft.ifft(both, axis=1)[:, :self.rows]


def _cut(values: np.ndarray, blocks: int) -> list[bytes]:
    """Blocks of frequencies (terms, width) as bytes."""
    return [np.ascontiguousarray(values[:, b * BLOCK:(b + 1) * BLOCK]).tobytes() for b in range(blocks)]


def _joined(parts: list[bytes], terms: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, np.complex128).reshape(terms, -1) for p in parts], axis=1)


def node_charges(positions: DataFrame, dims: int, grid: L.Grid, shift: np.ndarray) -> DataFrame:
    """``node_row, node_col, c0..``: sums of (1, y..) on the nodes, pre-summed in each Arrow batch."""
    names, plane = ys(dims), Plane.of(grid)
    terms = [f"c{k}" for k in range(dims + 1)]

    def spread(batches):
        for pdf in batches:
            if len(pdf):
                node, sums = L.grid_charges(grid, pdf[names].to_numpy(float) - shift)
                yield pd.DataFrame({"node_row": node // plane.cols, "node_col": node % plane.cols, **{t: sums[:, k] for k, t in enumerate(terms)}})

    schema = "node_row long, node_col long, " + ", ".join(f"{t} double" for t in terms)
    rows = positions.select(*names).mapInPandas(spread, schema)
    return rows.groupBy("node_row", "node_col").agg(*[F.sum(t).alias(t) for t in terms])


def convolved(charges: DataFrame, dims: int, grid: L.Grid, dof: float) -> DataFrame:
    """``box: array<long>, phi: array<double>``: for each box the force potentials of (1, y..) and the similarity potential of
    1 at its nodes, field by field."""
    plane, terms = Plane.of(grid), dims + 1
    spark: SparkSession = charges.sparkSession

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, part in pdf.groupby("node_row"):
            line = np.zeros((terms, plane.cols))
            line[:, part["node_col"].to_numpy(np.int64)] = part[[f"c{k}" for k in range(terms)]].to_numpy(float).T
            out += [(b, row, False, v) for b, v in enumerate(_cut(np.fft.rfft(line, 2 * plane.cols), plane.blocks))]
        return pd.DataFrame(out, columns=["block", "node_row", "kernel", "data"])

    def kernel_rows(batches):
        for pdf in batches:
            for row in pdf["id"]:
                yield pd.DataFrame([(b, row, True, v) for b, v in enumerate(_cut(plane.kernels(int(row), dof), plane.blocks))],
                                   columns=["block", "node_row", "kernel", "data"])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        width = len(pdf["data"].iloc[0]) // 16 // (2 if pdf["kernel"].iloc[0] else terms)
        charge, kernel = np.zeros((terms, plane.rows, width), complex), np.zeros((2, plane.rows + 1, width), complex)
        for row, is_kernel, data in zip(pdf["node_row"], pdf["kernel"], pdf["data"]):
            (kernel if is_kernel else charge)[:, row] = np.frombuffer(data, np.complex128).reshape(-1, width)
        fields = plane.across(charge, kernel)
        return pd.DataFrame({
            "block": pdf["block"].iloc[0], "node_row": np.arange(plane.rows),
            "data": [np.ascontiguousarray(fields[:, r]).tobytes() for r in range(plane.rows)],
        })

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = []
        for _, part in pdf.sort_values("block").groupby("node_row"):
            lines.append(np.fft.irfft(_joined(list(part["data"]), terms + 1), 2 * plane.cols)[:, :plane.cols])
        # (box rows, node rows in a box, fields, box columns, node columns in a box)
        stack = np.stack(lines).reshape(-1, plane.points[0], terms + 1, plane.cols // plane.points[1], plane.points[1])
        first = int(pdf["node_row"].min()) // plane.points[0]
        phi = stack.transpose(0, 3, 2, 1, 4).reshape(stack.shape[0], stack.shape[3], -1)
        boxes = [[first + r, c] if dims == 2 else [c] for r in range(phi.shape[0]) for c in range(phi.shape[1])]
        return pd.DataFrame({"box": boxes, "phi": list(phi.reshape(len(boxes), -1))})

    kind = "block long, node_row long, kernel boolean, data binary"
    lines = charges.groupBy(F.floor(F.col("node_row") / ROWS).alias("rows")).applyInPandas(along, kind)
    kernels = spark.range(plane.rows + 1 if plane.rows > 1 else 1).mapInPandas(kernel_rows, kind)
    blocks = lines.unionByName(kernels).groupBy("block").applyInPandas(across, "block long, node_row long, data binary")
    box_row = F.floor(F.col("node_row") / plane.points[0])
    return blocks.groupBy(box_row.alias("box_row")).applyInPandas(back, "box array<long>, phi array<double>")


def potentials(positions: DataFrame, dims: int, grid: L.Grid, dof: float, shift: np.ndarray | None = None) -> DataFrame:
    """``box, phi`` of the whole grid for the given rows (moved by ``-shift``)."""
    if dims > 2:
        raise ValueError("the interpolation grid supports one or two dimensions")
    return convolved(node_charges(positions, dims, grid, np.zeros(dims) if shift is None else shift), dims, grid, dof)


def felt(rows: DataFrame, field: DataFrame, dims: int, grid: L.Grid, shift: np.ndarray | None = None) -> DataFrame:
    """``rows`` with ``z, f0..``: the similarity sum, the row itself included, and the force from the field. A box that
    holds many rows is one join key, which the adaptive skew join splits on the rows' side."""
    names, move = ys(dims), np.zeros(dims) if shift is None else shift
    columns = rows.columns

    def placed(batches):
        for pdf in batches:
            yield pdf.assign(box=list(L.box_of(grid, pdf[names].to_numpy(float) - move)))

    def take(batches):
        for pdf in batches:
            y = pdf[names].to_numpy(float) - move
            phi = np.stack(pdf["phi"].to_numpy()) if len(pdf) else np.zeros((0, (dims + 2) * grid.points ** dims))
            got = L.weigh_nodes(grid, phi, y)
            force = y * got[:, :1] - got[:, 1: dims + 1]
            yield pdf[columns].assign(z=got[:, dims + 1], **{f"f{c}": force[:, c] for c in range(dims)})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    boxed = rows.mapInPandas(placed, f"{kinds}, box array<long>")
    out = f"{kinds}, z double, " + ", ".join(f"f{c} double" for c in range(dims))
    return boxed.join(field, "box").select(*columns, "phi").mapInPandas(take, out)
