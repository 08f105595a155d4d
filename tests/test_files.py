import gzip
import json

import pytest

from trefoil.operators import graph as G
from trefoil.operators import orbits as O
from trefoil.sources import files, sinks


def text(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body)
    return str(path)


def lines(path):
    return [x for part in sorted(__import__("pathlib").Path(path).glob("part-*")) for x in part.read_text().splitlines()]


def test_S1_graph_and_K1_K3_K4_dumps(spark, tmp_path):
    path = text(tmp_path, "g.in", "4 5\n0 1\n1 0\n2 2\n1 2\n0 2\n")
    edges, nodes = files.read_graph(spark, path)
    assert edges.count() == 3 and nodes.count() == 4
    counts = O.OrbitCounts(edges, nodes, 4)
    sinks.write_node_orbits(counts.node_orbits(), str(tmp_path / "n"), 4)
    assert [x.split()[:4] for x in lines(tmp_path / "n")] == [["2", "0", "0", "1"]] * 3 + [["0"] * 4]
    sinks.write_edge_orbits(counts.edge_orbits(), str(tmp_path / "e"), 4)
    assert [x.split()[1] for x in lines(tmp_path / "e")] == ["1", "1", "1"]
    sinks.write_totals(O.graphlet_totals(counts.node_orbits(), 4), str(tmp_path / "t"))
    assert lines(tmp_path / "t")[:2] == ["1\t0", "2\t1"]
    with pytest.raises(Exception):
        files.read_graph(spark, path, strict=True)[0].collect()
    with pytest.raises(Exception, match="out of range"):
        files.read_graph(spark, text(tmp_path, "bad.in", "2 1\n0 -1\n"))[0].collect()


def test_S4_S5_expression_and_K5(spark, tmp_path):
    body = "gene_symbol\ta\tb\tc\nX\t1\t2\t3\nY\t4\t5\t6\nX\t3\t4\t5\n"
    got = files.read_expression(spark, text(tmp_path, "x.tsv", body), 2)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [("a", 0, "X", 2.0), ("a", 1, "Y", 4.0), ("b", 0, "X", 3.0), ("b", 1, "Y", 5.0)]
    packed = tmp_path / "x.tsv.gz"
    packed.write_bytes(gzip.compress(body.encode()))
    assert files.read_expression(spark, str(packed)).count() == 6
    with pytest.raises(ValueError):
        files.read_expression(spark, text(tmp_path, "y.tsv", "gene\ta\n"))
    with pytest.raises(ValueError):
        files.read_expression(spark, text(tmp_path, "z.tsv", body), 9)
    with pytest.raises(ValueError):
        files.read_expression(spark, text(tmp_path, "w.tsv", "gene_symbol\ta\ta\nX\t1\t2\n"))
    with pytest.raises(Exception):
        files.read_expression(spark, text(tmp_path, "w.tsv", "gene_symbol\ta\nX\tnope\n")).collect()
    sinks.write_expression(got, str(tmp_path / "out"), ["a", "b"])
    assert files.read_expression(spark, str(next((tmp_path / "out").glob("part-*")))).count() == 4


def test_S6_S7_S8_J3_sets_and_symbols(spark, tmp_path):
    flat = files.read_gene_sets(spark, text(tmp_path, "f.json", json.dumps({"a": ["X", "", "X", "Y"], "b": ["Z"]})))
    assert sorted(map(tuple, flat.collect())) == [("a", "X"), ("a", "Y"), ("b", "Z")]
    nested = files.read_gene_sets(spark, text(tmp_path, "n.json", json.dumps({"a": {"geneSymbols": ["X"], "pmid": "1"}})))
    assert list(map(tuple, nested.collect())) == [("a", "X")]
    probes = files.read_probe_map(spark, text(tmp_path, "p.tsv", "id\tgene\n1\tX\n1\tY\n2\t.\n3\tX\n"))
    assert sorted(map(tuple, probes.collect())) == [("1", "X"), ("3", "X")]
    e = spark.createDataFrame([("s", 0, "1", 1.0), ("s", 1, "3", 3.0), ("s", 2, "2", 9.0)],
                              "sample string, row_idx long, gene string, value double")
    assert [tuple(r) for r in files.map_symbols(e, probes, flat).collect()] == [("s", "X", 0, 2.0)]
    sinks.write_gene_sets(flat, str(tmp_path / "sets"))
    assert json.loads(lines(tmp_path / "sets")[0]) == {"a": ["X", "Y"]}


def test_S9_S11_S12_J16_K7_records(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.append_results(spark.createDataFrame([("x", 1, 5.0)], "impl string, n int, s double").coalesce(1), log)
    one = text(tmp_path, "r.jsonl", '{"impl":"x","n":1,"s":5}\n{"impl":"x","n":1,"s":7}\n{"impl":"y","n":1,"s":2}\n')
    got = files.read_results(spark, one, ["impl", "n"])
    assert {r["impl"]: r["s"] for r in got.collect()} == {"x": 7, "y": 2}
    assert files.read_results(spark, log, ["impl"]).count() == 1
    csv = files.read_timings(spark, text(tmp_path, "t.csv", "n,a,b\n1,2.5,\n"), "n")
    assert {r["impl"]: r["seconds"] for r in csv.collect()} == {"a": 2.5, "b": None}
    jobs = spark.createDataFrame([("x", 1), ("z", 1)], "impl string, n int")
    assert [r["impl"] for r in files.pending(jobs, got, ["impl", "n"]).collect()] == ["z"]
    pts = spark.range(100)
    assert files.subsample(pts, 10, 1).count() == 10
    assert G.degrees(G.clean_edges(spark.createDataFrame([(0, 1)], "src int, dst int"))).count() == 2
