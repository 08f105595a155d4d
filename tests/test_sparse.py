import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from trefoil.functions import lists as P
from trefoil.operators import graph as G
from trefoil.operators import sparse as S
from trefoil.operators.sparse import sparse_knn


def brute(x, k, metric):
    """(i, j, d) by all pairs; rows that share nothing are at distance 1."""
    out = []
    for i in range(len(x)):
        row = []
        for j in range(len(x)):
            if i == j:
                continue
            if metric == "cosine":
                size = np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])
                sim = x[i] @ x[j] / size if size else 0.0
            else:
                a, b = x[i] > 0, x[j] > 0
                sim = (a & b).sum() / max((a | b).sum(), 1)
            row.append((round(1 - sim, 9), j))
        out += [(i, j, d) for d, j in sorted(row)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
@pytest.mark.parametrize("rare, chunk", [(256, 4096), (6, 5), (0, 4096)])
def test_sparse_neighbours_equal_all_pairs(spark, metric, rare, chunk):
    rng = np.random.default_rng(5)
    x = np.zeros((90, 40))
    for i, row in enumerate(x[:85]):  # the last five rows are empty
        row[rng.choice(40, 1 + i % 6, replace=False, p=np.r_[0.4, np.full(39, 0.6 / 39)])] = rng.integers(1, 5)
        row[0] = 1 + i % 3  # one dimension that every row holds
    x[30:60] = x[30]  # a third of the rows are alike
    x[84] = 0
    x[84, 39], x[:84, 39] = 2, 0  # shares nothing
    cells = [(int(i), int(d), float(x[i, d])) for i, d in zip(*np.nonzero(x))] + [(3, 7, 0.0), (None, 1, 2.0), (4, None, 1.0)]
    cells += [(i, 0, 0.0) for i in range(3)]
    rows = spark.createDataFrame(cells, "id long, dim long, weight double")
    ids = spark.range(90)
    got = sorted((r["i"], r["j"], round(r["d"], 9), r["rk"]) for r in sparse_knn(rows, 7, metric, ids, rare, chunk).collect())
    want = brute(x, 7, metric)
    assert len(got) == 90 * 7
    for i in range(90):
        mine, true = [g for g in got if g[0] == i], [w for w in want if w[0] == i]
        assert sorted(g[2] for g in mine) == [w[2] for w in true]
        assert sorted(g[3] for g in mine) == list(range(1, 8))
        last = true[-1][2]  # the order of ties within rounding isn't fixed by brute force
        assert {g[1] for g in mine if g[2] < last} == {w[1] for w in true if w[2] < last}
    exact = {(i, j) for i, j, _ in want if i >= 84}
    assert {(g[0], g[1]) for g in got if g[0] >= 84} == exact  # filled with the smallest ids


def test_sparse_repeats_empty_tables_and_errors(spark):
    schema = "id long, dim string, weight double, extra string"
    twice = spark.createDataFrame([(1, "a", 1.0, "x"), (1, "a", 2.0, "y"), (2, "a", 3.0, None), (2, "b", 4.0, None)], schema)
    got = {(r["i"], r["j"], round(r["d"], 9)) for r in sparse_knn(twice, 5).collect()}
    assert got == {(1, 2, 0.4), (2, 1, 0.4)}
    assert sparse_knn(spark.createDataFrame([], schema), 3).count() == 0
    with pytest.raises(Exception, match="0 or more"):
        sparse_knn(spark.createDataFrame([(1, "a", -1.0, "")], schema), 3).count()
    with pytest.raises(ValueError, match="hamming"):
        sparse_knn(twice, 3, "hamming")


def test_one_node_in_half_of_all_edges(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB_CHUNK", 16)
    rng = np.random.default_rng(8)
    pairs = {(0, v) for v in range(1, 121)}
    while len(pairs) < 240:
        x, y = sorted(map(int, rng.choice(np.arange(1, 121), 2, replace=False)))
        pairs.add((x, y))
    edges = spark.createDataFrame(sorted(pairs), "x long, y long")
    near = {v: set() for v in range(121)}
    for x, y in pairs:
        near[x].add(y)
        near[y].add(x)
    degs = {(r["x"], r["y"]): (r["dx"], r["dy"]) for r in G.with_degrees(edges).collect()}
    assert degs == {(x, y): (len(near[x]), len(near[y])) for x, y in pairs}
    tri = {(r["x"], r["y"]): r["triangles"] for r in G.edge_triangles(edges, 16).collect()}
    assert tri == {(x, y): len(near[x] & near[y]) for x, y in pairs}
    co = {(r["x"], r["z"]): r["codegree"] for r in G.codegrees(edges, 16).collect()}
    assert co == {(x, z): len(near[x] & near[z]) for x in near for z in near if x < z and near[x] & near[z]}
    four = {r["v"]: r["n_cliques"] for r in G.node_cliques(edges, 4).collect()}
    assert four[0] == sum(len(near[x] & near[y] & near[0]) for x, y in pairs if x and y) // 3


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
def test_pairs_of_sparse_rows_are_not_shuffled(spark, metric):
    """Lists travel to the rows that ask them; a pair is made, added up and ranked in its row's partition."""
    rng = np.random.default_rng(3)
    cells = [(i, int(d), 1.0) for i in range(60) for d in rng.choice(30, 6, replace=False)]
    entries = S._entries(spark.createDataFrame(cells, "id long, dim long, weight double"), metric)
    met = S._lists_met(entries, entries, 4096)
    by = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\w+)", met._jdf.queryExecution().executedPlan().toString())
    assert by and ("i", "j") not in by
    want = {(a, b): 0 for a in range(60) for b in range(60) if a != b}
    for (a, d, _), (b, e, _) in itertools.product(cells, cells):
        if a != b and d == e:
            want[a, b] += 1
    assert {(r["i"], r["j"]): r["dot"] for r in met.collect()} == {p: n for p, n in want.items() if n}


@pytest.mark.parametrize("kind", ["whole", "doubles", "extreme"])
def test_packed_lists_are_lossless(kind):
    rng = np.random.default_rng(7)
    many = rng.integers(1, 40, 300)
    span = 1 << (62 if kind == "extreme" else 22)
    ids = np.concatenate([np.sort(rng.integers(-span, span, m)) for m in many])
    w = {"whole": rng.integers(1, 51, len(ids)).astype(float), "doubles": rng.random(len(ids)), "extreme": 10.0 ** rng.uniform(-150, 150, len(ids))}[kind]
    sizes = w * w
    packed = P.pack(ids, w, sizes, many)
    raw, ends = np.frombuffer(b"".join(packed), np.uint8), np.cumsum([0] + [len(x) for x in packed])
    assert P.lengths(raw, ends[:-1]).tolist() == many.tolist()
    got = P.unpack(raw, ends[:-1])
    assert all(np.array_equal(a, b) for a, b in zip(got, (ids, w, sizes, np.repeat(np.arange(300), many))))
    if kind == "whole":
        assert len(raw) < 0.45 * 24 * len(ids)  # an entry was three numbers of 8 bytes


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_sums_of_a_row_go_on_from_piece_to_piece(spark, monkeypatch, piece):
    """A pair of rows was a row of Spark until it was ranked."""
    rng = np.random.default_rng(8)
    cells = [(i, int(d), float(rng.integers(1, 9))) for i in range(40) for d in rng.choice(12, 5, replace=False)]
    entries = S._entries(spark.createDataFrame(cells, "id long, dim long, weight double"), "cosine")
    rows = [(e["id"], e["dim"], e["w"], e["size"]) for e in entries.collect()]
    by = {d: sorted((i, w, z) for i, e, w, z in rows if e == d) for d in range(12)}
    batch = pa.RecordBatch.from_pylist([
        {"i": i, "wi": w, "size_i": z, "es": P.pack(*(np.array(x) for x in zip(*by[d])), np.array([len(by[d])]))[0]} for i, d, w, z in sorted(rows)])
    monkeypatch.setattr(S, "PIECE_PAIRS", piece)
    got = pa.Table.from_batches(list(S._summed([batch.slice(0, 90), batch.slice(90, 0), batch.slice(90)], None))).to_pylist()
    x = np.zeros((40, 12))
    for i, d, w, _ in rows:
        x[i, d] = w
    assert {(r["i"], r["j"]): r["dot"] for r in got} == {(i, j): (x @ x.T)[i, j] for i in range(40) for j in range(40) if i != j and x[i] @ x[j]}
    thin = pa.Table.from_batches(list(S._summed([batch], (3, "cosine")))).to_pylist()
    assert len(got) > len(thin) >= 40 * 3
    assert sorted(map(tuple, S._lists_met(entries, entries, 4096).select("i", "j", "dot").collect())) == sorted((r["i"], r["j"], r["dot"]) for r in got)
