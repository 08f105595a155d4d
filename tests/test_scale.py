"""Steps whose memory, shuffled rows or work must not grow with the square of the input."""

import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trefoil.functions import layout as L
from trefoil.functions import metrics
from trefoil.functions.kernels import Nearest
from trefoil.operators import affinity as A
from trefoil.operators import enrichment as E
from trefoil.operators import graph as G
from trefoil.operators import initial as I
from trefoil.operators import neighbors as N
from trefoil.plans.registry import QUERIES
from trefoil.sources import tables as T


def test_walk_over_an_open_tree_holds_a_bounded_number_of_pairs():
    rng = np.random.default_rng(0)
    place = np.sort(rng.normal(0, 5, 4000))
    rows = pd.DataFrame({"parent": 1, "name": (1 << 20) + np.arange(4000), "n": 1, "leaf": True, "m0": place})
    y = rng.normal(0, 5, (1000, 1))
    tracemalloc.start()
    z, f = L.walk_cells(L.cells_of(rows, 1, 40.0, 4000, [0.0]), y, 0.0, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gap = y - place[None]
    q, w = L.student(gap ** 2, 1.0)
    assert np.allclose(z, q.sum(1)) and np.allclose(f[:, 0], (w * gap).sum(1))
    assert peak < 100e6


@pytest.mark.parametrize("theta", [0.0, 0.3, 1.0])
def test_cells_that_all_rows_open_are_opened_once(theta):
    """Every row opened every cell by itself, pair by pair."""
    rng = np.random.default_rng(1)
    place = np.sort(rng.uniform(0, 1, 1024))
    rows = pd.DataFrame([(name >> 1, name, 1 << 9 - lv, lv == 9) for lv in range(10) for name in range(1 << lv + 1, 1 << lv + 2)],
                        columns=["parent", "name", "n", "leaf"])
    rows["m0"] = [place.reshape(1 << int(name).bit_length() - 1, -1)[name - (1 << int(name).bit_length() - 1)].mean() for name in rows["name"]]
    tree, y = L.cells_of(rows, 1, 1.0, 1024, [place.mean()]), place[100:140, None]
    fine = 1024 + np.arange(100, 140)
    leaves, others = L._opened_by_all(tree, 0.25 ** tree.level, y, theta)
    assert theta > 0 or (len(leaves) == 1024 and not len(others))
    z, f = L.walk_cells(tree, y, theta, 1.0, fine, 10)
    alone = [L.walk_cells(tree, y[i:i + 1], theta, 1.0, fine[i:i + 1], 10) for i in range(40)]
    assert np.allclose(z, [a[0][0] for a in alone]) and np.allclose(f, [a[1][0] for a in alone])
    if theta == 0:
        gap = y - place[None]
        assert np.allclose(z, (1 / (1 + gap ** 2)).sum(1) - 1) and np.allclose(f[:, 0], (gap / (1 + gap ** 2) ** 2).sum(1))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "canberra", "spearmanr", "wasserstein_1d", "jensen_shannon",
                                    "bit_hamming"])
@pytest.mark.parametrize("shape", ["plain", "ties", "outlier", "tiny"])
def test_screens_lose_no_neighbour_and_measure_few_pairs(metric, shape):
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(0, 0.2, (700, 16)))
    if shape == "ties":
        x = np.round(x * 4)
        x[:200] = x[0]
        x[200:210] = 0
    elif shape == "outlier":
        x[5, 3] = 1e12
    elif shape == "tiny":
        x[:300] *= 1e-30
    if metric == "bit_hamming":
        x = np.floor(x * 1000) % 256
    fn, ids = metrics.METRICS[metric], np.arange(700) * 3
    near = Nearest(ids, x, ids, x, 6, fn, metric, True)
    near.meet(np.arange(700), np.arange(700))
    dist = np.asarray(fn(x[:, None], x[None]), float)
    np.fill_diagonal(dist, np.inf)
    best = np.argsort(dist, axis=1, kind="stable")[:, :6]
    assert np.allclose(near.d, np.take_along_axis(dist, best, 1), rtol=1e-12, atol=1e-12)
    if shape != "tiny":  # equal up to rounding there, where the order of sums decides
        assert (near.j == best * 3).mean() > 0.999
    if shape == "plain":
        again = Nearest(ids, x, ids, x, 6, fn, metric, True, near.limit)
        measured = []
        exact = again.screen.exact
        again.screen.exact = lambda a, b: measured.append(len(a)) or exact(a, b)
        again.meet(np.arange(700), np.arange(700))
        assert (again.j == near.j).all() and sum(measured) < 700 * 700 / 10


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "spearmanr"])
def test_exact_join_copies_rows_a_fixed_number_of_times(spark, monkeypatch, metric):
    """Blocks of 20 rows met pairwise: a row was copied once for every block, on both sides."""
    x = np.random.default_rng(6).normal(0, 1, (400, 6))
    x[:150] = x[0]  # cells that share one place
    monkeypatch.setattr(N, "TILES", 4)
    monkeypatch.setattr(N, "TILE_LEAST", 50)
    carried = []
    meet = N._TileMeet.__call__
    monkeypatch.setattr(N._TileMeet, "__call__", lambda self, q, r, pairs: carried.append(len(pairs)) or meet(self, q, r, pairs))
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    got = N.exact_knn(pts, 5, metric, block_rows=20).select("i", "j", "d")
    assert len(carried) == 2 and sum(carried) <= 16  # tiles of 100 rows
    dist = np.asarray(metrics.METRICS[metric](x[:, None], x[None]), float)
    np.fill_diagonal(dist, np.inf)
    want = np.sort(dist, 1)[:, :5]
    have = got.toPandas().sort_values(["i", "d"])["d"].to_numpy().reshape(400, 5)
    assert np.allclose(have, want, atol=1e-9)


def test_exact_join_sends_a_tile_once_for_both_directions(spark, monkeypatch):
    """Each direction of two tiles was a pair of its own, and tables of a few thousand rows were cut into fewer tiles a side."""
    x = np.random.default_rng(7).normal(0, 1, (400, 6))
    x[:200] = x[:200].astype(np.float32)
    monkeypatch.setattr(N, "TILES", 4)
    monkeypatch.setattr(N, "TILE_LEAST", 50)
    carried = []
    meet = N._TileMeet.__call__
    monkeypatch.setattr(N._TileMeet, "__call__", lambda self, q, r, pairs: carried.append(pairs) or meet(self, q, r, pairs))
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    got = N.exact_knn(pts, 5, block_rows=20).toPandas().sort_values(["i", "rk"])
    assert all(a == b for a, b in carried[0]) and all(a < b for a, b in carried[1]) and len(carried[1]) <= 6
    dist = metrics.METRICS["euclidean"](x[:, None], x[None])
    np.fill_diagonal(dist, np.inf)
    assert (got["j"].to_numpy().reshape(400, 5) == np.argsort(dist, axis=1, kind="stable")[:, :5]).all()


def test_packed_tiles_keep_every_entry(spark):
    x = np.random.default_rng(8).normal(0, 1, (60, 3))
    x[0] = [1e300, -0.0, np.nan]
    for rows in (x, np.nan_to_num(x[1:]).astype(np.float32).astype(float)):
        tiles = spark.createDataFrame([(i, [float(v) for v in r], i % 5, i % 2) for i, r in enumerate(rows)],
                                      "id long, features array<double>, cell long, tile int").coalesce(1)
        packed = N._packed(tiles).toPandas()
        assert sorted(packed["tile"]) == [0, 1] and set(packed["single"]) == {len(rows) < 60}
        ids, entries, cells, bounds = N._unpacked(packed)
        assert sorted(ids) == list(range(len(rows))) and (cells == ids % 5).all() and np.isinf(bounds).all()
        assert np.array_equal(entries, rows[ids], equal_nan=True)


def _tables(folder, spark, sf, parts: int) -> str:
    """The tables at ``sf`` with ``parts`` parts of one brand."""
    for name in ("lineitem", "orders", "customer", "nation"):
        (folder / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet").filter("p_partkey = 1").drop("p_partkey")
    spark.range(1, parts + 1).select(F.col("id").alias("p_partkey")).crossJoin(F.broadcast(part)).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_no_set_of_the_asked_size_gives_no_scores(spark, sf, tmp_path):
    many = _tables(tmp_path, spark, sf, 120)
    assert QUERIES["ssgsea_sizes"](spark, many).count() == 0
    with pytest.raises(Exception, match="no gene set"):
        E.score(T.expression(spark, many), T.gene_sets(spark, many), min_size=75, max_size=90).count()


def test_prefix_of_no_qualifying_set_gives_no_scores(spark, sf, tmp_path):
    assert QUERIES["ssgsea_prefix"](spark, _tables(tmp_path, spark, sf, 10_001)).count() == 0


def test_table_of_all_distances_is_thinned_before_it_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIR_ROWS", 100)
    x = np.random.default_rng(2).normal(0, 1, (300, 4))
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    dist = N.all_distances(pts, "manhattan")
    assert dist.count() == 300 * 299 and dist.filter("i = j").count() == 0
    assert N._best_of_batches(dist, 5).count() < 300 * 299 / 5
    want = {(r["i"], r["j"], r["rk"]) for r in N.exact_knn(pts, 5, "manhattan").collect()}
    assert {(r["i"], r["j"], r["rk"]) for r in N.precomputed_knn(dist, 5).collect()} == want
    odd = spark.createDataFrame([(1, 2, None), (1, 3, 0.5), (1, 4, float("nan")), (1, 1, 0.0), (2, 1, 0.5)], "i long, j long, d double")
    assert [(r["i"], r["j"], r["rk"]) for r in N.precomputed_knn(odd, 3).orderBy("i", "rk").collect()] == [
        (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 1)]


@pytest.mark.parametrize("dims, dof", [(1, 1.0), (2, 0.8), (3, 1.0)])
def test_exact_repulsion_works_on_small_tiles(dims, dof):
    rng = np.random.default_rng(1)
    y, other = rng.normal(0, 5, (300, dims)), rng.normal(0, 5, (5000, dims))
    other[4000:4100] = y[:100]
    other_ids = np.r_[np.arange(1000, 5000), np.arange(100), np.arange(9000, 9900)]
    tracemalloc.start()
    z, f = L.met_exactly(np.arange(300), y, other_ids, other, dof)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gap = y[:, None] - other[None]
    q, w = L.student((gap ** 2).sum(-1), dof)
    same = np.arange(300)[:, None] == other_ids[None]
    q[same], w[same] = 0, 0
    assert same.sum() == 100 and np.allclose(z, q.sum(1)) and np.allclose(f, (w[..., None] * gap).sum(1))
    assert peak < 5e6


def test_spectral_walk_deals_the_affinities_once(spark, monkeypatch):
    """A step shuffled the affinities and wrote every term so far again."""
    rng = np.random.default_rng(9)
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 1, (200, 3)))], "id long, features array<double>")
    p = A.uniform(N.exact_knn(pts, 12), "mean")
    plans, widths = [], []
    walked, keep = I._walked, I.written

    def step(edges, term, parts, cols):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        moved = walked(edges, term, parts, cols)
        plans.append(moved._jdf.queryExecution().executedPlan().toString())
        return moved

    monkeypatch.setattr(I, "_walked", step)
    monkeypatch.setattr(I, "written", lambda df: widths.append(len(df.columns)) or keep(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)  # more than the parts of the affinities
    try:
        y = np.array([list(r)[1:] for r in I.spectral(p, 2, add_jitter=False).orderBy("id").collect()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    dealt = [re.findall(r"Exchange hashpartitioning\(j#\d+L?, (\d+)", plan) for plan in plans]
    assert dealt and all("SortMergeJoin" in plan for plan in plans) and all(set(d) == {"12"} for d in dealt)
    assert max(widths) == 2 + 2 + 1 + 2
    m = np.zeros((200, 200))
    for r in p.collect():
        m[r["i"], r["j"]] = r["p"]
    w = 1 / np.sqrt(m.sum(1))
    vec = np.linalg.eigh(m * w[:, None] * w[None])[1][:, ::-1] * w[:, None]
    assert all(abs(np.corrcoef(y[:, c], vec[:, c + 1])[0, 1]) > 0.9999 for c in range(2))


def test_approximate_join_moves_rows_only_to_their_blocks(spark, monkeypatch):
    """The blocks met themselves as two sides, and rows were shuffled to meet the count of their cell."""
    x = np.random.default_rng(10).normal(0, 1, (300, 4)).astype(np.float32).astype(float)
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    placed = N._assign(pts, x[:6], metrics.METRICS["euclidean"], 2).select("id", "features", "cell")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        side = N._blocks(placed, 40)
        found = N._meet_own(side, ["cell", "part"], 3, N.space_of("euclidean"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    both = N._meet(side, side, ["cell", "part"], 3, N.space_of("euclidean"), True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, both.collect()))
    assert dict(N._slim(pts).dtypes)["features"] == "array<float>"
    third = pts.withColumn("features", F.transform("features", lambda v: v / 3))
    assert dict(N._slim(third).dtypes)["features"] == "array<double>"


@pytest.mark.parametrize("chunk,walks", [(4096, 1 << 21), (4, 30), (1000, 50)])
def test_walks_of_squares_travel_as_lists(spark, chunk, walks):
    """Every walk was a row of a join, and was shuffled twice."""
    rng = np.random.default_rng(11)
    a = np.triu(rng.random((40, 40)) < 0.2, 1)
    a[0, 1:] = a[1, 2:30] = True  # hubs
    edges = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a))], "src long, dst long")
    found = G.edge_squares(G.with_degrees(G.clean_edges(edges)), chunk, walks)
    if chunk == 4096:
        # The only join is that of hubs with the pieces of their lists.
        assert len(re.findall(r"\w+Join ", found._jdf.queryExecution().executedPlan().toString())) == 1
    m = (a | a.T).astype(int)
    through = m * (m @ m @ m - m.sum(0)[None] - m.sum(1)[:, None] + 1)
    want = {(int(i), int(j)): int(through[i, j]) for i, j in zip(*np.nonzero(a)) if through[i, j]}
    assert {(r["x"], r["y"]): r["squares"] for r in found.collect()} == want


def test_squares_of_a_graph_without_any(spark):
    for rows in ([], [(0, 1), (1, 2), (0, 2), (2, 3)]):
        edges = G.clean_edges(spark.createDataFrame(rows, "src long, dst long"))
        assert G.edge_squares(G.with_degrees(edges)).count() == 0


def test_spectral_restarts_keep_what_the_cycles_before_found(spark, monkeypatch):
    """A cycle began anew from a block of its own, so values close to each other took many times the steps: 19 cycles here."""
    n = 160
    w = np.zeros((n, n))  # a path: its leading values differ by less than 0.002
    w[np.arange(n - 1), np.arange(1, n)] = w[np.arange(1, n), np.arange(n - 1)] = 1
    p = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(w))], "i long, j long, p double")
    cycles, ritz = [], I._ritz
    monkeypatch.setattr(I, "_ritz", lambda *a: cycles.append(1) or ritz(*a))
    y = np.array([list(r)[1:] for r in I.spectral(p, 2, add_jitter=False).orderBy("id").collect()])
    want = np.cos(np.pi * np.arange(n)[:, None] * np.arange(1, 3) / (n - 1))
    assert all(abs(np.corrcoef(y[:, c], want[:, c])[0, 1]) > 0.99999 for c in range(2))
    assert len(cycles) <= 8


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "canberra"])
def test_table_of_all_distances_as_lists(spark, monkeypatch, metric):
    """Every pair was a row of its own, measured in both orders."""
    monkeypatch.setattr(N, "PAIR_ROWS", 70)
    x = np.random.default_rng(3).normal(0, 1, (250, 4))
    x[200:] = x[0]  # ties, more of them than neighbours
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    lists = N.all_distances(pts, metric, wide=True)
    assert lists.columns == ["i", "js", "ds"] and lists.agg(F.sum(F.size("js"))).first()[0] == 250 * 249
    assert lists.filter("array_contains(js, i)").isEmpty() and lists.filter("size(js) <> size(ds)").isEmpty()
    want = sorted(map(tuple, N.precomputed_knn(N.all_distances(pts, metric), 5).collect()))
    assert sorted(map(tuple, N.precomputed_knn(lists, 5).collect())) == want and len(want) == 250 * 5
    odd = spark.createDataFrame([(1, [1, 2, 3], [0.0, 2.0, 1.0]), (1, [4], [0.5]), (2, [1, 5], [float("nan"), 1.0])], "i long, js array<long>, ds array<double>")
    assert [(r["i"], r["j"], r["rk"]) for r in N.precomputed_knn(odd, 2).orderBy("i", "rk").collect()] == [(1, 4, 1), (1, 3, 2), (2, 5, 1), (2, 1, 2)]
