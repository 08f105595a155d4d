"""Nearest neighbours as block joins: ``knn(i, j, d, rk)``.

Rows are put into blocks of bounded size by their closest pivot; a crowded pivot is cut by hash, so
a large group of equal rows never lands in one task. Blocks meet blocks in cogrouped tasks, each
keeping only the k best of every query, and a ranked merge finishes.

* exact: cells travel in tiles, about ``TILES`` of them a side until a tile has ``TILE_ENTRIES`` entries, so that rows are
  copied a fixed number of times, packed, and once for both directions of two tiles. A tile first meets itself, which bounds the k-th distance of its rows; then it meets
  every other tile, cell by cell, but for cells that the triangle inequality rules out (none for metrics without it).
  Cheap lower bounds (``functions.screens``) say which pairs are measured;
* approximate: a row meets the blocks of its few closest pivots (crowded cells get pivots of their own, level by
  level), then optionally its neighbours' neighbours.

Blocks keep their size whatever the number of rows. A zero vector is at cosine distance 1 from every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trefoil.functions import metrics
from trefoil.functions.kernels import Nearest, block_top_k
from trefoil.functions.screens import SCREENS
from trefoil.session import BROADCAST_ROWS, cut_lineage

BLOCK_ROWS = 4096
# Pivots of the first level, held on the driver; they bound cells, not the size of blocks.
MAX_PIVOTS = 1024
# Pivots within a crowded cell, and levels of them, of the approximate join.
FANOUT, LEVELS = 64, 6
# Tiles a side of the exact join, and the bounds of a tile: rows that are worth a task, and entries that it may hold.
TILES, TILE_LEAST, TILE_ENTRIES = 12, 1024, 1 << 22
# Rows a side of a block of the table of all distances; a task hands out the square of it at once.
PAIR_ROWS = 1024
# Tasks of that table at most.
PAIR_TASKS = 1024
# Entries a row that neighbour descent keeps at least.
DESCENT_LIST = 30
# Metrics the tree-based approximate index supports.
TREE_METRICS = ("cosine", "euclidean", "manhattan", "hamming", "dot", "l1", "l2", "taxicab")

_HIT = "i long, j long, d double"
_WIDE_HIT = "i long, js array<long>, ds array<double>"


@dataclass(frozen=True)
class Space:
    """A metric, how its rows are prepared, and which geometry may prune."""

    fn: Callable
    prune: Callable | None
    unit: bool
    screen: str
    finish: Callable | None


def space_of(metric: str | Callable, params: dict | None = None) -> Space:
    name, fn = metrics.resolve(metric, params)
    if name in ("cosine", "angular"):
        # Chord length on unit vectors orders rows as the angle does.
        finish = (lambda d: d * d / 2.0) if name == "cosine" else None
        return Space(_chord, metrics.euclidean, True, "euclidean", finish)
    prune = fn if name in metrics.TRIANGLE else None
    return Space(fn, prune, False, name if name in SCREENS and not params else "", None)


def _chord(a, b):
    """Distance of unit vectors whose last entry marks zero vectors; those stand at a right angle to all rows, each other too."""
    d = metrics.euclidean(a[..., :-1], b[..., :-1])
    return np.where((a[..., -1] == 1) | (b[..., -1] == 1), np.sqrt(2.0), d)


def _from_data(points: DataFrame, metric: str | Callable, params: dict | None) -> dict | None:
    """Parameters that are taken from the data unless given: variances or the inverse covariance of the features."""
    params, f = dict(params or {}), F.col("features")
    if metric == "seuclidean" and params.get("V") is None:
        wide = range(len(points.select("features").first()[0]))
        params["V"] = np.array(points.agg(*[F.var_samp(f[c]).alias(f"v{c}") for c in wide]).first(), dtype=float)
    if metric == "mahalanobis" and params.get("VI") is None:
        n = len(points.select("features").first()[0])
        both = [(a, b) for a in range(n) for b in range(a, n)]
        found = points.agg(*[F.covar_samp(f[a], f[b]).alias(f"v{a}_{b}") for a, b in both]).first()
        cov = np.zeros((n, n))
        for (a, b), v in zip(both, found):
            cov[a, b] = cov[b, a] = v
        params["VI"] = np.linalg.inv(cov)
    return params or None


def _prepare(points: DataFrame, space: Space) -> DataFrame:
    v = F.col("features").cast("array<double>")
    if space.unit:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        v = F.when(norm == 0, F.concat(v, F.array(F.lit(1.0)))).otherwise(
            F.concat(F.transform(v, lambda x: x / norm), F.array(F.lit(0.0))))
    return points.select(F.col("id").cast("long").alias("id"), v.alias("features"))


def _merge(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("i").orderBy("d", "j")
    return hits.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= k)


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_list()).astype(float)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], k: int, space: Space, same: bool) -> DataFrame:
    """Cogroup query and reference blocks on ``keys`` and keep each query's k best per block."""
    fn, screen = space.fn, space.screen

    def join(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(r) == 0:
            return pd.DataFrame({"i": [], "j": [], "d": []})
        i, j, d = block_top_k(
            q["id"].to_numpy(), _stack(q["features"]), r["r_id"].to_numpy(), _stack(r["r_features"]),
            k, fn, screen, same,
        )
        return pd.DataFrame({"i": i, "j": j, "d": d})

    # Own names for the right side: both sides may come from the same table.
    other = right.toDF(*[f"r_{c}" for c in right.columns])
    grouped = other.groupBy(*[f"r_{key}" for key in keys])
    return left.groupBy(*keys).cogroup(grouped).applyInPandas(join, _HIT)


def _meet_own(side: DataFrame, keys: list[str], k: int, space: Space) -> DataFrame:
    """The k best of every row within its block: ``_meet`` of a side with itself, whose rows travel once."""
    fn, screen = space.fn, space.screen

    def join(q: pd.DataFrame) -> pd.DataFrame:
        ids, x = q["id"].to_numpy(), _stack(q["features"])
        return pd.DataFrame(dict(zip("ijd", block_top_k(ids, x, ids, x, k, fn, screen, True))))

    return side.groupBy(*keys).applyInPandas(join, _HIT)


def _small(counted: DataFrame) -> DataFrame:
    """A table of cells, broadcast if its count allows it, so that the rows it is joined to stay where they are."""
    return F.broadcast(counted) if counted.count() <= BROADCAST_ROWS else counted


def _slim(rows: DataFrame) -> DataFrame:
    """``id, features`` in single precision if that holds every entry exactly."""
    same = F.forall("features", lambda x: x.cast("float").cast("double") == x)
    exact = rows.agg(F.min(F.coalesce(same, F.lit(False)))).first()[0]
    return rows.withColumn("features", F.col("features").cast("array<float>")) if exact else rows


def _pivots(ref: DataFrame, count: int, salt: int = 0) -> np.ndarray:
    """A bounded, repeatable choice of rows by hash order (at most MAX_PIVOTS vectors)."""
    rows = (
        ref.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(min(count, MAX_PIVOTS)).select("features").collect()
    )
    return np.array([r[0] for r in rows], dtype=float)


def _assign(points: DataFrame, pivots: np.ndarray, geometry: Callable, near: int = 1) -> DataFrame:
    """Add ``cell`` and ``reach`` (distance to it) for each of the ``near`` closest pivots."""
    near = min(near, len(pivots))

    def place(batches):
        for pdf in batches:
            x = _stack(pdf["features"]) if len(pdf) else np.zeros((0, pivots.shape[1]))
            step = max(1, 4_000_000 // max(1, pivots.size))
            dist = np.concatenate(
                [geometry(x[a:a + step, None, :], pivots[None]) for a in range(0, len(x), step)]
                or [np.zeros((0, len(pivots)))]
            )
            order = np.argsort(dist, axis=1, kind="stable")[:, :near]
            rows = np.repeat(np.arange(len(x)), near)
            out = pdf.iloc[rows].copy()
            out["cell"] = order.ravel()
            out["reach"] = dist[rows, order.ravel()]
            yield out

    return points.mapInPandas(place, "id long, features array<double>, cell long, reach double")


def _blocks(placed: DataFrame, block_rows: int) -> DataFrame:
    """Cut crowded cells by hash so that every (cell, part) stays near ``block_rows``."""
    crowd = _small(cut_lineage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))))
    parts = F.greatest(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(1))
    return (
        placed.join(crowd, "cell")
        .withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("long"))
        .drop("_n")
    )


def exact_knn(points: DataFrame, k: int, metric: str | Callable = "euclidean", params: dict | None = None,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest other rows of every row; ties by id; a row is never its own neighbour."""
    space = space_of(metric, _from_data(points, metric, params))
    rows = _prepare(points, space)
    return _exact(rows, rows, k, space, True, block_rows)


def query_knn(reference: DataFrame, queries: DataFrame, k: int, metric: str | Callable = "euclidean",
              params: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest reference rows of every query row, exact hits included."""
    space = space_of(metric, _from_data(reference, metric, params))
    return _exact(_prepare(queries, space), _prepare(reference, space), k, space, False, block_rows)


def _exact(q: DataFrame, r: DataFrame, k: int, space: Space, same: bool, block_rows: int) -> DataFrame:
    n = r.count()
    if k < 1 or k > n - int(same):
        raise ValueError(f"k={k} does not fit {n} reference rows")
    n_q = n if same else q.count()
    if n <= block_rows and n_q <= block_rows:
        # The references fit one block: only the queries are cut, to use every core.
        parts = min(q.sparkSession.sparkContext.defaultParallelism, -(-n_q // 256))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        left = q.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(parts)))
        hits = _meet(left, r.withColumn("a", every), ["a"], k, space, same)
    else:
        hits = _pruned_meet(q, r, k, space, same, block_rows, n)
    out = _merge(hits, k)
    if space.finish is not None:
        out = out.withColumn("d", space.finish(F.col("d")))
    return out.select("i", "j", "d", "rk")


def _pruned_meet(q: DataFrame, r: DataFrame, k: int, space: Space, same: bool, block_rows: int, n: int) -> DataFrame:
    """Which tiles meet is decided on the driver, over at most MAX_PIVOTS cells a side; within two tiles the task decides
    it cell by cell, by the distances found so far."""
    geometry = space.prune or metrics.euclidean
    pivots = _pivots(r, max(2, -(-n // block_rows)))
    size = max(TILE_LEAST, -(-n // TILES))
    size = max(1, min(size, TILE_ENTRIES // pivots.shape[1]))
    r_tiles, r_side = _tiled(_assign(r, pivots, geometry), size)
    q_tiles, q_side = (r_tiles, r_side) if same else _tiled(_assign(q, pivots, geometry), size)
    gap = np.array([geometry(pivots[c][None], pivots[r_side["cell"]]) for c in q_side["cell"]]).reshape(len(q_side), len(r_side))
    low = gap - q_side["radius"].to_numpy(float)[:, None] - r_side["radius"].to_numpy(float)[None]
    if space.prune is None:
        low = np.full(low.shape, -np.inf)
    meet = _TileMeet(k, space, same, q_side["cell"].to_numpy(), r_side["cell"].to_numpy(), low if space.prune else None)
    pairs = _tile_pairs(q_side, r_side, np.ones(low.shape, bool), size)
    if not same:
        return meet(_packed(q_tiles), _packed(r_tiles), pairs)
    every = _packed(q_tiles)
    own = cut_lineage(meet(every, every, [(a, b) for a, b in pairs if a == b]))
    kth = own.groupBy("i").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("bound")).withColumnRenamed("i", "id")
    bound = F.coalesce("bound", F.lit(float("inf"))).alias("bound")
    known = cut_lineage(q_tiles.join(kth, "id", "left").select("id", "features", "cell", "tile", bound))
    worst = known.groupBy("cell").agg(F.max("bound").alias("d")).orderBy("cell").toPandas()["d"].to_numpy(float)
    pairs = _tile_pairs(q_side, r_side, low <= worst[:, None] + 1e-9, size)
    # One task does both directions of two tiles, so that neither travels twice.
    both = sorted({(min(a, b), max(a, b)) for a, b in pairs if a != b})
    every = _packed(known)
    return own.unionByName(meet(every, every, both))


def _tiled(placed: DataFrame, size: int) -> tuple[DataFrame, pd.DataFrame]:
    """``id, features, cell, tile`` and the table of cells: their radius, number of rows and the rows before them. Cells fill
    tiles of about ``size`` rows one after the other, a row at a place that its hash gives it within its cell."""
    placed = cut_lineage(placed)
    side = placed.groupBy("cell").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("rows")).orderBy("cell").toPandas()
    side["before"] = side["rows"].cumsum() - side["rows"]
    cells = placed.sparkSession.createDataFrame(side[["cell", "rows", "before"]], "cell long, rows long, before long")
    place = F.col("before") + F.pmod(F.xxhash64("id"), F.col("rows"))
    return placed.join(F.broadcast(cells), "cell").select(  # at most MAX_PIVOTS rows
        "id", "features", "cell", F.floor(place / F.lit(size)).cast("int").alias("tile")), side


def _tile_pairs(q_side: pd.DataFrame, r_side: pd.DataFrame, keep: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Tiles of which at least one pair of cells is kept."""
    def holds(side: pd.DataFrame) -> np.ndarray:
        first, last = side["before"] // size, (side["before"] + side["rows"] - 1) // size
        tile = np.arange(int(last.max()) + 1)[:, None]
        return ((tile >= first.to_numpy()[None]) & (tile <= last.to_numpy()[None])).astype(float)

    met = holds(q_side) @ keep.astype(float) @ holds(r_side).T
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(met))]


def _packed(tiles: DataFrame) -> DataFrame:
    """Rows of one tile, batch by batch, as one row of bytes: in single precision where that holds every entry exactly, else
    in double. ``bound`` is infinite where ``tiles`` has none."""
    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells, tile, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "cell", "tile", "bound"))
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            with np.errstate(over="ignore", invalid="ignore"):
                single = x.astype(np.float32)
            if np.array_equal(single.astype(float), x):
                x = single
            names = np.unique(tile)
            rows = [np.flatnonzero(tile == name) for name in names]
            yield pa.RecordBatch.from_pydict({
                "tile": pa.array(names, pa.int32()), "single": pa.array([x.dtype == np.float32] * len(names)),
                **{c: pa.array([v[at].tobytes() for at in rows], pa.binary()) for c, v in (
                    ("ids", ids), ("cells", cells), ("bounds", bound.astype(float)), ("entries", x))},
            })

    if "bound" not in tiles.columns:
        tiles = tiles.withColumn("bound", F.lit(float("inf")))
    return tiles.select("id", "features", "cell", "tile", "bound").mapInArrow(
        pack, "tile int, single boolean, ids binary, cells binary, bounds binary, entries binary")


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, entries, cells and bounds of packed rows."""
    def whole(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(v, kind) for v in rows[name]])

    entries = [np.frombuffer(v, np.float32 if single else float).reshape(len(ids) // 8, -1)
               for v, single, ids in zip(rows["entries"], rows["single"], rows["ids"])]
    return whole("ids", np.int64), np.concatenate(entries).astype(float), whole("cells", np.int64), whole("bounds", float)


@dataclass(frozen=True)
class _TileMeet:
    """Brings packed query and reference tiles together and keeps each query's k best per pair of tiles; of the ``same`` rows
    each asks the other tile's. ``low`` is a distance that rows of a query cell and a reference cell are not below, if the
    metric allows one."""

    k: int
    space: Space
    same: bool
    q_cells: np.ndarray
    r_cells: np.ndarray
    low: np.ndarray | None

    def __call__(self, q_tiles: DataFrame, r_tiles: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
        spark, parts = q_tiles.sparkSession, max(1, len(pairs))

        def sent(tiles: DataFrame, ends: list[tuple[int, int, int]]) -> DataFrame:
            # TILES squared pairs until tiles are full: a small table.
            return tiles.join(F.broadcast(spark.createDataFrame(ends, "pair int, side int, tile int")), "tile")

        left = [(n, 0, a) for n, (a, _) in enumerate(pairs)]
        right = [(n, 1, b) for n, (a, b) in enumerate(pairs) if not self.same or a != b]
        packed = sent(q_tiles, left + right) if self.same else sent(q_tiles, left).unionByName(sent(r_tiles, right))
        # A partition a pair: small tables would be coalesced, and a hash may deal one task several, though pairs are much work.
        return packed.repartitionById(parts, "pair").groupBy("pair").applyInPandas(self._join(), _HIT)

    def _join(self) -> Callable:
        k, space, same, q_cells, r_cells, low = self.k, self.space, self.same, self.q_cells, self.r_cells, self.low

        def hits(q, r):
            (q_ids, x, q_cell, bound), (r_ids, y, r_cell, _) = q, r
            near = Nearest(q_ids, x, r_ids, y, min(k, len(y)), space.fn, space.screen, same, bound)
            if low is None:
                near.meet(np.arange(len(x)), np.arange(len(y)))
            else:
                at_r = np.searchsorted(r_cells, r_cell)
                for cell in np.unique(q_cell):
                    floor = low[np.searchsorted(q_cells, cell)][at_r]
                    order = np.argsort(floor, kind="stable")
                    near.meet(np.flatnonzero(q_cell == cell), order, floor[order])
            return pd.DataFrame(dict(zip("ijd", near.hits())))

        def join(rows: pd.DataFrame) -> pd.DataFrame:
            sides = [_unpacked(rows[rows["side"] == side]) for side in sorted(set(rows["side"]))]
            if same:
                met = [(sides[0], sides[-1]), (sides[-1], sides[0])][:len(sides)]
            else:
                met = [tuple(sides)] if len(sides) == 2 else []
            return pd.concat([hits(q, r) for q, r in met] or [pd.DataFrame({"i": [], "j": [], "d": []})])

        return join


def _near_blocks(rows: DataFrame, n: int, geometry: Callable, probes: int, block_rows: int, seed: int) -> DataFrame:
    """``id, features, cell, part``: the closest pivots of every row, then the closest pivot within each crowded cell,
    level by level, so that blocks keep their size and stay close together whatever the number of rows. Rows
    that no pivot tells apart are cut by hash."""
    limit = block_rows * probes
    pivots = _pivots(rows, -(-n // block_rows) * 2, seed)
    placed = _assign(rows, pivots, geometry, probes).select("id", "features", "cell")
    for level in range(1, LEVELS):
        placed = cut_lineage(placed)
        crowd = cut_lineage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit))
        if crowd.isEmpty():
            break
        placed = _split(placed, crowd, geometry, limit, seed + level)
    return _blocks(placed, limit)


def _split(placed: DataFrame, crowd: DataFrame, geometry: Callable, limit: int, salt: int) -> DataFrame:
    """Rows of crowded cells move to the closest of FANOUT pivots chosen in their cell, in tasks of bounded size."""
    parts, crowd = F.ceil(F.col("_n") / F.lit(limit)), _small(crowd)
    full = placed.join(crowd, "cell").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("long"))
    order = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(salt)), "id")
    picked = (
        full.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= FANOUT)
        .select(F.col("cell").alias("p_cell"), F.col("_r").alias("turn"), F.col("features").alias("pivot"),
                F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("p_part"))
    )

    def move(x: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        out = x[["id", "features", "cell"]].copy()
        if len(x):
            centres, at = _stack(pivots.sort_values("turn")["pivot"]), _stack(x["features"])
            step = max(1, 4_000_000 // max(1, centres.size))
            best = [geometry(at[a:a + step, None, :], centres[None]).argmin(1) for a in range(0, len(at), step)]
            out["cell"] = out["cell"] * FANOUT + np.concatenate(best)
        return out

    moved = full.groupBy("cell", "part").cogroup(picked.groupBy("p_cell", "p_part")).applyInPandas(
        move, "id long, features array<double>, cell long")
    calm = placed.join(crowd, "cell", "left_anti")
    return moved.unionByName(calm.select("id", "features", (F.col("cell") * FANOUT).alias("cell")))


def approx_knn(points: DataFrame, k: int, metric: str | Callable = "euclidean", params: dict | None = None,
               probes: int = 3, tables: int = 2, refine: int = 1, fanout: int = 10,
               block_rows: int = 1024, seed: int = 0) -> DataFrame:
    """Approximate neighbours: every row joins the blocks of its ``probes`` closest pivots in each of
    ``tables`` independent pivot choices, then ``refine`` rounds look at neighbours of neighbours.

    A block is at least 4k rows; equal rows cut into several parts still meet k equals in their part.
    """
    space = space_of(metric, _from_data(points, metric, params))
    geometry = space.prune or metrics.euclidean
    rows = cut_lineage(_prepare(points, space))
    n = rows.count()
    if k < 1 or k > n - 1:
        raise ValueError(f"k={k} does not fit {n} rows")
    block_rows = max(block_rows, 4 * k)
    found = None
    for t in range(tables):
        side = _near_blocks(rows, n, geometry, probes, block_rows, seed + t * LEVELS).select("id", "features", "cell", "part")
        hits = _meet_own(side, ["cell", "part"], k, space)
        found = hits if found is None else found.unionByName(hits)
    best = cut_lineage(_merge(found.groupBy("i", "j").agg(F.min("d").alias("d")), k))
    slim = _slim(rows) if refine else rows
    for _ in range(refine):
        best = cut_lineage(_refined(best, slim, k, space, fanout))
    if space.finish is not None:
        best = best.withColumn("d", space.finish(F.col("d")))
    return best.select("i", "j", "d", "rk")


def _refined(best: DataFrame, rows: DataFrame, k: int, space: Space, fanout: int) -> DataFrame:
    """Join each row with its closest neighbours' closest neighbours and keep the k best."""
    near = best.filter(F.col("rk") <= fanout)
    hop = near.select("i", F.col("j").alias("m")).join(
        near.select(F.col("i").alias("m"), "j"), "m"
    )
    fresh = (
        hop.filter(F.col("i") != F.col("j")).select("i", "j").dropDuplicates()
        .join(best.select("i", "j"), ["i", "j"], "left_anti")
    )
    measured = (
        fresh.join(rows.toDF("i", "fi"), "i").join(rows.toDF("j", "fj"), "j")
        .select("i", "j", _measure(space.fn).alias("d"))
    )
    return _merge(best.select("i", "j", "d").unionByName(measured), k)


def _measure(fn: Callable):
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        if len(a) == 0:
            return pd.Series([], dtype=float)
        return pd.Series(np.asarray(fn(_stack(a), _stack(b)), dtype=float))

    return F.pandas_udf(batch, "double")(F.col("fi"), F.col("fj"))


def all_distances(points: DataFrame, metric: str | Callable = "euclidean", params: dict | None = None, wide: bool = False) -> DataFrame:
    """``i, j, d`` for every two different rows, in both orders; ``wide`` gives them as lists ``i, js, ds``, one for each block of
    other rows, which costs a pair a copy of two numbers instead of a row. The table has the square of the rows and is handed
    out block by block: it is neither shuffled nor held anywhere. A metric that is exactly symmetric is taken once for both orders."""
    space = space_of(metric, _from_data(points, metric, params))
    rows = cut_lineage(_prepare(points, space))
    parts = max(1, -(-rows.count() // PAIR_ROWS))
    both = space.prune is not None
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long")
    first, last = F.lit(0).cast("long"), F.lit(parts - 1).cast("long")
    left = rows.select("id", "features", own.alias("a")).withColumn("b", F.explode(F.sequence(F.col("a") if both else first, last)))
    right = rows.select(F.col("id").alias("r_id"), F.col("features").alias("r_features"), own.alias("r_b"))
    right = right.withColumn("r_a", F.explode(F.sequence(first, F.col("r_b") if both else last)))
    fn, finish = space.fn, space.finish or (lambda d: d)

    def lists(ids: np.ndarray, others: np.ndarray, d: np.ndarray) -> pa.Table:
        other = ids[:, None] != others[None]
        js, ends = np.broadcast_to(others, d.shape)[other], np.append(0, other.sum(1).cumsum())
        if not wide:
            return pa.table({"i": np.repeat(ids, np.diff(ends)), "j": js, "d": d[other]})
        ends = pa.array(ends, pa.int32())
        return pa.table({"i": ids, "js": pa.ListArray.from_arrays(ends, js), "ds": pa.ListArray.from_arrays(ends, d[other])})

    def measure(q: pa.Table, r: pa.Table) -> pa.Table:
        q_ids, r_ids = q.column("id").to_numpy(), r.column("r_id").to_numpy()
        if not len(q_ids) or not len(r_ids):
            return lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)))
        x, y = _entries_of(q.column("features")), _entries_of(r.column("r_features"))
        step = max(1, 250_000 // y.size)
        d = finish(np.concatenate([np.asarray(fn(x[at:at + step, None, :], y[None]), dtype=float) for at in range(0, len(x), step)]))
        made = lists(q_ids, r_ids, d)
        if not both or q.column("a")[0] == q.column("b")[0]:
            return made
        return pa.concat_tables([made, lists(r_ids, q_ids, d.T)])

    # Not left to the coalescing of small partitions: their pairs are much work.
    tasks = min(parts * parts, PAIR_TASKS)
    left, right = left.repartition(tasks, "a", "b"), right.repartition(tasks, "r_a", "r_b")
    return left.groupBy("a", "b").cogroup(right.groupBy("r_a", "r_b")).applyInArrow(measure, _WIDE_HIT if wide else _HIT)


def _entries_of(features: pa.ChunkedArray) -> np.ndarray:
    return features.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)


def _best_of_lists(dist: DataFrame, k: int) -> DataFrame:
    """``i, j, d`` of the others in every list that fewer than k of it are nearer than."""
    def best(batches):
        for batch in batches:
            i, js, ds = (batch.column(c) for c in ("i", "js", "ds"))
            i, many = i.to_numpy(zero_copy_only=False), np.diff(js.offsets.to_numpy())
            j, d = (v.flatten().to_numpy(zero_copy_only=False) for v in (js, ds))
            d = np.where(j == np.repeat(i, many), np.inf, d)  # nobody's own neighbour
            starts, keep = np.cumsum(many) - many, np.zeros(len(d), bool)
            for size in np.unique(many[many > 0]):
                rows = np.flatnonzero(many == size)
                for at in range(0, len(rows), max(1, 1_000_000 // size)):
                    of = starts[rows[at:at + max(1, 1_000_000 // size)], None] + np.arange(size)
                    near = d[of]
                    keep[of] = ~(near > np.partition(near, min(k, size) - 1, axis=1)[:, min(k, size) - 1, None])
            keep &= j != np.repeat(i, many)
            yield pa.RecordBatch.from_pydict({"i": np.repeat(i, many)[keep], "j": j[keep], "d": d[keep]})

    return dist.select("i", "js", "ds").mapInArrow(best, _HIT)


def _best_of_batches(hits: DataFrame, k: int) -> DataFrame:
    """``i, j, d`` without rows that k others next to them are nearer than, so that a merge shuffles what is left only."""
    def best(batches):
        for batch in batches:
            i, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "d"))
            if batch.column("d").null_count:
                d = np.where(batch.column("d").is_null(), -np.inf, d)  # a missing distance comes first, NaN last, as in the merge
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
            ends, keep = np.append(starts[1:], len(i)), np.ones(len(i), bool)
            for run in np.flatnonzero(ends - starts > k):
                of = slice(starts[run], ends[run])
                keep[of] = ~(d[of] > np.partition(d[of], k - 1)[k - 1])
            yield batch.filter(pa.array(keep))

    return hits.mapInArrow(best, _HIT)


def precomputed_knn(dist: DataFrame, k: int) -> DataFrame:
    """From distances ``i, j, d``, or lists of them ``i, js, ds``: the k nearest others of every i."""
    if "js" in dist.columns:
        lists = dist.select(F.col("i").cast("long").alias("i"), F.col("js").cast("array<long>").alias("js"), F.col("ds").cast("array<double>").alias("ds"))
        return _merge(_best_of_lists(lists, k), k)
    others = dist.filter(F.col("i") != F.col("j")).select(
        F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d"))
    return _merge(_best_of_batches(others, k), k)


def precomputed_query(dist: DataFrame, k: int) -> DataFrame:
    """Rows are queries, columns are references; exact hits are kept."""
    return _merge(dist.select("i", "j", "d"), k)


def nearest(points: DataFrame, k: int, method: str = "auto", metric: str | Callable = "euclidean",
            params: dict | None = None, seed: int = 0) -> DataFrame:
    """Pick the join: ``exact``, or the approximate one (``auto`` too, whatever the number of rows).

    ``annoy`` is the projection forest, ``pynndescent`` neighbour descent from a small forest, and ``hnsw`` the approximate join
    with more effort; each accepts the metrics of the index of that name.
    """
    from trefoil.operators import forest  # builds on this module

    if metric == "precomputed":
        return precomputed_knn(points, k)
    if method == "exact":
        return exact_knn(points, k, metric, params)
    if method in ("auto", "approx"):
        return approx_knn(points, k, metric, params, seed=seed)
    if method == "annoy":
        if metric not in TREE_METRICS:
            raise ValueError(f"annoy does not support {metric!r}")
        return forest.Forest.build(points, metric, params, trees=16, k=k, seed=seed).own(k)
    if method == "pynndescent":
        return descent_knn(points, k, metric, params, seed=seed)
    if method == "hnsw":
        if metric not in ("cosine", "euclidean", "dot", "l2", "ip"):
            raise ValueError(f"hnsw does not support {metric!r}")
        found = approx_knn(points, k, metric, params, probes=4, tables=2, refine=1, seed=seed)
        # This index reports squared lengths under the name l2.
        return found.withColumn("d", F.col("d") * F.col("d")) if metric == "l2" else found
    raise ValueError(f"unknown neighbour method {method!r}")


def descent_knn(points: DataFrame, k: int, metric: str | Callable = "euclidean", params: dict | None = None, trees: int = 2,
                sample: int = 10, rounds: int = 12, change: float = 0.001, seed: int = 0) -> DataFrame:
    """Neighbour descent that starts from the leaves of a small forest.

    Lists shorter than the dimension of the neighbourhoods stall in a local optimum, so at least ``DESCENT_LIST`` entries
    a row are kept on the way; the k best of them are returned.
    """
    from trefoil.operators import descent, forest  # both build on this module

    made = forest.Forest.build(points, metric, params, trees=trees, k=k, seed=seed)
    rows = cut_lineage(_prepare(points, made.space))
    raw = replace(made, space=replace(made.space, finish=None))
    width = max(k, min(DESCENT_LIST, made.n - 1))
    best, _ = descent.descend(raw.own(width), rows, width, made.space, sample, rounds, change, seed)
    best = best.filter(F.col("rk") <= k)
    if made.space.finish is not None:
        best = best.withColumn("d", made.space.finish(F.col("d")))
    return best


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of true neighbour pairs that were found."""
    hit = truth.select("i", "j").join(
        found.select("i", "j").withColumn("hit", F.lit(1)), ["i", "j"], "left"
    )
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def symmetric_graph(knn: DataFrame) -> DataFrame:
    """Undirected edges ``src < dst`` joining rows of which one is a neighbour of the other."""
    return knn.select(
        F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")
    ).dropDuplicates()


__all__ = [
    "all_distances", "approx_knn", "exact_knn", "nearest", "precomputed_knn", "precomputed_query",
    "query_knn", "recall", "symmetric_graph",
]
