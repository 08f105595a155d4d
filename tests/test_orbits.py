import random
from functools import lru_cache
from itertools import combinations
from math import comb

import pytest
from pyspark.sql import functions as F

from trefoil.functions import features, patterns
from trefoil.operators import enumerate as U
from trefoil.operators import graph as G
from trefoil.operators import orbits as O
from trefoil.plans import registry


def raw(spark, edges):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "edge_id long, src long, dst long")


@lru_cache(None)
def classes(k, mask):
    edges = [p for i, p in enumerate(combinations(range(k), 2)) if mask >> i & 1]
    try:
        return [patterns.class_of_root(edges, r) for r in range(k)], edges
    except (ValueError, IndexError):
        return None


def brute(n, edges, size):
    """Classify every vertex subset."""
    nbrs = patterns.adjacency(edges, n)
    look = {}
    for o, (g, a, b) in patterns.edge_orbits().items():
        orbits = patterns.GRAPHLETS[g][1]
        look[tuple(sorted((orbits[a], orbits[b])))] = o
    nodes = {v: [0] * patterns.N_NODE_ORBITS[size] for v in range(n)}
    links = {tuple(sorted(e)): [0] * patterns.N_EDGE_ORBITS[size] for e in edges}
    for k in range(2, size + 1):
        for chosen in combinations(range(n), k):
            mask = sum(1 << i for i, (a, b) in enumerate(combinations(chosen, 2)) if b in nbrs[a])
            found = classes(k, mask) if mask else None
            if found is None or len({x for e in found[1] for x in e}) < k:
                continue
            for at, v in enumerate(chosen):
                nodes[v][found[0][at]] += 1
            for a, b in found[1] if k > 2 else []:
                links[(chosen[a], chosen[b])][look[tuple(sorted((found[0][a], found[0][b])))]] += 1
    return nodes, links


def test_G7_taxonomy_shape():
    assert len(patterns.node_orbits()) == 73 and len(patterns.edge_orbits()) == 69
    for size, given in ((4, features.SMALL), (5, features.LARGE)):
        picked, nodes = patterns.solve_nodes(given, size)
        assert len(nodes) == patterns.N_NODE_ORBITS[size] == len(picked)
        assert len(patterns.solve_edges(given, size)) == patterns.N_EDGE_ORBITS[size]


@pytest.mark.parametrize("size, hub", [(4, 99), (5, 99), (5, 6), (5, 5)])
def test_G3_G4_G5_G6_against_brute_force(spark, size, hub):
    random.seed(7)
    n = 13
    edges = [e for e in combinations(range(n), 2) if random.random() < 0.45]
    counts = O.OrbitCounts(G.clean_edges(raw(spark, edges)), spark.range(n + 1).toDF("v"), size, 3, hub_degree=hub)
    nodes, links = brute(n, edges, size)
    nodes[n] = [0] * patterns.N_NODE_ORBITS[size]
    assert {r["v"]: list(r)[1:] for r in counts.node_orbits().collect()} == nodes
    assert {(r["src"], r["dst"]): list(r)[3:] for r in counts.edge_orbits().collect()} == links


GOLD = [
    ([(0, 1), (0, 2), (1, 2)], 0, {0: 2, 3: 1}),
    (list(combinations(range(4), 2)), 0, {0: 3, 3: 3, 14: 1}),
    (list(combinations(range(5), 2)), 0, {0: 4, 3: 6, 14: 4, 72: 1}),
    ([(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)], 0, {0: 2, 1: 2, 2: 1, 4: 2, 5: 2, 34: 1}),
    ([(0, 1), (0, 2), (0, 3), (0, 4)], 0, {0: 4, 2: 6, 7: 4, 23: 1}),
    ([(0, 1), (0, 2), (0, 3), (0, 4)], 1, {0: 1, 1: 3, 6: 3, 22: 1}),
]


def test_hand_goldens_in_one_graph(spark):
    edges, want = [], {}
    for at, (part, node, orbits) in enumerate(GOLD):
        edges += [(a + 10 * at, b + 10 * at) for a, b in part]
        want[node + 10 * at] = orbits
    counts = O.OrbitCounts(G.clean_edges(raw(spark, edges)), None, 5)
    got = {r["v"]: {o: x for o, x in enumerate(list(r)[1:]) if x} for r in counts.node_orbits().collect()}
    assert {v: got[v] for v in want} == want
    totals = {r["graphlet"]: r["n"] for r in O.graphlet_totals(counts.node_orbits()).collect()}
    assert totals[29] == 1 and totals[8] == 6 and totals[15] == 1 and totals[11] == 2


def test_hub_is_split_and_four_node_counts_stay_small(spark):
    leaves = 60
    edges = [(0, i) for i in range(1, leaves + 1)] + [(1, 2)]
    counts = O.OrbitCounts(G.clean_edges(raw(spark, edges)), None, 4, chunk=8)
    hub = counts.node_orbits().filter("v = 0").first()
    assert hub["o0"] == leaves and hub["o3"] == 1 and hub["o2"] == leaves * (leaves - 1) // 2 - 1


def test_hub_is_not_expanded_in_five_node_counts(spark):
    leaves = 300
    edges = [(0, i) for i in range(1, leaves + 1)] + [(1, 2)]
    counts = O.OrbitCounts(G.clean_edges(raw(spark, edges)), None, 5, hub_degree=50)
    hub = counts.node_orbits().filter("v = 0").first()
    free = leaves - 2
    assert hub["o23"] == comb(leaves, 4) - comb(free, 2)
    assert hub["o33"] == comb(free, 2) and hub["o3"] == 1 and hub["o14"] == 0


def test_S1_S2_edge_cleaning(spark):
    messy = raw(spark, [(1, 0), (0, 1), (2, 2), (1, 2)])
    assert sorted((r["x"], r["y"], r["edge_id"]) for r in G.clean_edges(messy, 3).collect()) == [(0, 1, 0), (1, 2, 3)]
    for bad in ([(0, 1), (1, 0)], [(2, 2)]):
        with pytest.raises(Exception):
            G.clean_edges(raw(spark, bad), 3, strict=True).collect()
    for bad in ([(0, 3)], [(-1, 1)]):
        with pytest.raises(Exception, match="out of range"):
            G.clean_edges(raw(spark, bad), 3).collect()


def test_wide_arithmetic_agrees(spark):
    edges = G.clean_edges(raw(spark, list(combinations(range(6), 2))))
    long = O.OrbitCounts(edges, None, 4).node_orbits().orderBy("v").collect()
    wide = O.OrbitCounts(edges, None, 4, wide=True).node_orbits().orderBy("v").collect()
    assert [[int(x) for x in r] for r in wide] == [list(r) for r in long]


def test_G1_G8_listing_agrees_with_counting(spark):
    from trefoil.operators.enumerate import enumerated_node_orbits, taxonomy

    assert len(taxonomy(5)) == 728 and len(taxonomy(4)) == 38
    random.seed(2)
    edges = [e for e in combinations(range(10), 2) if random.random() < 0.4]
    clean = G.clean_edges(raw(spark, edges)).persist()
    nodes, _ = brute(10, edges, 5)
    got = enumerated_node_orbits(clean, spark.range(10).toDF("v"), 5)
    assert {r["v"]: list(r)[1:] for r in got.collect()} == nodes


def test_G12_command_line(spark, tmp_path):
    from trefoil.__main__ import main

    (tmp_path / "g.in").write_text("3 3\n0 1\n1 2\n0 2\n")
    main(["orbits", "node", "4", str(tmp_path / "g.in"), str(tmp_path / "out")])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[0].split()[:4] == ["2", "0", "0", "1"]


@pytest.mark.parametrize("k", [3, 4, 5])
def test_listed_subsets_of_a_hub_are_dealt_over_tasks(spark, k):
    """Every connected set once with its graphlet, also when a node's rows are cut over many chunks."""
    random.seed(11)
    n = 14
    edges = sorted({(0, v) for v in range(1, n)} | {e for e in combinations(range(1, n), 2) if random.random() < 0.15})
    nbrs = patterns.adjacency(edges, n)
    want = {}
    for chosen in combinations(range(n), k):
        mask = sum(1 << i for i, (a, b) in enumerate(combinations(chosen, 2)) if b in nbrs[a])
        known = {m: (g, orbits) for m, g, orbits in U.taxonomy(k)}
        if mask in known:
            want[chosen] = known[mask]
    table = G.clean_edges(raw(spark, edges))
    got = U.classified_subsets(table, k, task_rows=20).collect()
    assert len(got) == len(want) and {tuple(r["m"]): (r["graphlet"], r["orbits"]) for r in got} == want
    listed = U.connected_subsets(table, k, task_rows=20)
    assert {tuple(r["m"]) for r in listed.collect()} == set(want)
    if k > 3:
        sizes = [r["count"] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < len(want) / 4


def test_edges_are_kept_for_the_graph_queries(spark):
    """They read the edges more than once, and the neighbour join behind these must run once."""
    plan = registry._graph(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Exchange" not in plan
