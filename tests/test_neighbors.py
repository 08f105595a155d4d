import numpy as np
import pytest
from pyspark.sql import functions as F

from trefoil.functions import metrics
from trefoil.operators import affinity as A
from trefoil.operators import descent, forest
from trefoil.operators import neighbors as N
from trefoil.operators import tsne as S
from trefoil.operators.forest import Forest


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def brute(q, r, k, metric, same, params=None):
    _, fn = metrics.resolve(metric, params)
    out = {}
    for a in range(len(q)):
        d = np.array([float(fn(q[a], r[b])) for b in range(len(r))])
        if same:
            d[a] = np.inf
        order = np.lexsort((np.arange(len(r)), d))[:k]
        out[a] = [(int(b), round(float(d[b]), 7)) for b in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("i", "rk").collect():
        out.setdefault(r["i"], []).append((r["j"], round(r["d"], 7)))
    return out


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    return np.vstack([rng.normal(c, 1, (60, 5)) for c in (0, 4)])


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "chebyshev", "braycurtis", "correlation"])
def test_T1_X4_exact_small_blocks(spark, blobs, metric):
    assert got(N.exact_knn(frame(spark, blobs), 7, metric, block_rows=25)) == brute(blobs, blobs, 7, metric, True)


def test_X4_parameters_and_callable(spark, blobs):
    x = blobs[:40]
    assert got(N.exact_knn(frame(spark, x), 3, "minkowski", {"p": 3})) == brute(x, x, 3, "minkowski", True, {"p": 3})
    named = got(N.exact_knn(frame(spark, x), 3, "manhattan"))
    assert got(N.exact_knn(frame(spark, x), 3, lambda a, b: np.abs(a - b).sum())) == named
    ones = spark.createDataFrame([([1.0, 0.0, 1.0], [1.0, 1.0, 0.0])], "a array<double>, b array<double>")
    jac = ones.select(metrics.distance(F.col("a"), F.col("b"), "jaccard").alias("d")).first()["d"]
    assert jac == pytest.approx(2 / 3)


def test_J7_query_keeps_exact_hits(spark, blobs):
    found = got(N.query_knn(frame(spark, blobs), frame(spark, blobs[:20]), 4, block_rows=30))
    assert found == brute(blobs[:20], blobs, 4, "euclidean", False)
    assert all(found[i][0] == (i, 0.0) for i in found)


def test_equal_rows_are_split_not_collected(spark):
    x = np.vstack([np.zeros((90, 3)), np.random.default_rng(1).normal(5, 1, (30, 3))])
    assert got(N.exact_knn(frame(spark, x), 5, block_rows=20)) == brute(x, x, 5, "euclidean", True)
    near = N.approx_knn(frame(spark, x), 5, block_rows=20)
    assert near.filter("i < 90").agg(F.max("d")).first()[0] == 0.0


def test_blocks_keep_their_size_beyond_the_first_pivots(spark, blobs, monkeypatch):
    monkeypatch.setattr(N, "MAX_PIVOTS", 3)
    monkeypatch.setattr(N, "FANOUT", 4)
    assert got(N.exact_knn(frame(spark, blobs), 7, block_rows=10)) == brute(blobs, blobs, 7, "euclidean", True)
    pts = frame(spark, np.random.default_rng(3).normal(0, 1, (600, 4)))
    rows = N._prepare(pts, N.space_of("euclidean"))
    made = N._near_blocks(rows, 600, metrics.euclidean, 2, 20, 0)
    sizes = [r["count"] for r in made.groupBy("cell", "part").count().collect()]
    assert max(sizes) <= 2 * 40 and sum(sizes) == 1200
    assert made.filter("part > 0").count() == 0  # parted by pivots, not by hash
    found = N.approx_knn(pts, 5, block_rows=20, tables=3)
    assert N.recall(found, N.exact_knn(pts, 5)).first()[0] > 0.85


def test_X8_zero_vectors_and_X4_parameters_from_the_data(spark, blobs):
    x = np.vstack([blobs[:30], np.zeros((3, 5)), -blobs[:5]])
    for size in (7, 4096):
        assert got(N.exact_knn(frame(spark, x), 37, "cosine", block_rows=size)) == brute(x, x, 37, "cosine", True)
    for metric, params in (("seuclidean", {"V": x.var(0, ddof=1)}), ("mahalanobis", {"VI": np.linalg.inv(np.cov(x.T))})):
        found = {i: [round(d, 5) for _, d in v] for i, v in got(N.exact_knn(frame(spark, x), 4, metric)).items()}
        want = {i: [round(d, 5) for _, d in v] for i, v in brute(x, x, 4, metric, True, params).items()}
        assert found == want


def test_T2_T3_T4_approximate_recall_and_T7_dispatch(spark, blobs):
    pts = frame(spark, np.random.default_rng(3).normal(0, 1, (600, 8)))
    truth = N.exact_knn(pts, 10).persist()
    found = N.approx_knn(pts, 10, block_rows=60)
    assert N.recall(found, truth).first()[0] > 0.85
    assert found.filter("i = j").count() == 0 and found.count() == 6000
    assert got(N.nearest(pts, 3)) == got(N.exact_knn(pts, 3))
    for bad in (("annoy", "canberra"), ("hnsw", "manhattan"), ("nope", "euclidean")):
        with pytest.raises(ValueError):
            N.nearest(pts, 3, *bad)
    with pytest.raises(ValueError):
        N.exact_knn(pts, 600)


def test_T5_precomputed(spark, blobs):
    dist = N.exact_knn(frame(spark, blobs), 119).select("i", "j", "d")
    assert got(N.nearest(dist, 7, metric="precomputed")) == brute(blobs, blobs, 7, "euclidean", True)


def calibrated(d, perplexity):
    """Plain bisection on one row."""
    lo, hi, tau = -np.inf, np.inf, 1.0
    for _ in range(200):
        p = np.sqrt(tau) * np.exp(-d * d * tau / 2)
        s = p.sum() + np.finfo(float).eps
        gap = tau / 2 * (p / s * d * d).sum() + np.log(s) - np.log(tau) / 2 - np.log(perplexity)
        if abs(gap) <= 1e-8:
            break
        if gap > 0:
            lo, tau = tau, (tau * 2 if np.isinf(hi) else (tau + hi) / 2)
        else:
            hi, tau = tau, (tau / 2 if np.isinf(lo) else (tau + lo) / 2)
    return p / p.sum()


def test_X1_calibration_and_T8_invariants(spark, blobs):
    knn = N.exact_knn(frame(spark, blobs), 30).persist()
    rows = {r["i"]: r["d"] for r in knn.groupBy("i").agg(F.sort_array(F.collect_list("d")).alias("d")).collect()}
    own = {}
    for r in A.conditional(knn, [10.0]).join(knn, ["i", "j"]).orderBy("i", "rk").collect():
        own.setdefault(r["i"], []).append(r["p"])
    for i in rows:
        assert np.allclose(own[i], calibrated(np.array(rows[i]), 10.0), atol=1e-12)
    p = A.perplexity_based(knn, 10, 30).persist()
    assert p.agg(F.sum("p")).first()[0] == pytest.approx(1)
    back = p.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("q"))
    assert p.join(back, ["i", "j"]).filter(F.abs(F.col("p") - F.col("q")) < 1e-15).count() == p.count()
    same = A.multiscale(knn, [10.0]).join(p.withColumnRenamed("p", "q"), ["i", "j"])
    assert same.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-14
    each = A.to_new(knn, [5.0, 8.0]).groupBy("i").agg(F.sum("p").alias("s"))
    assert each.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-12


def test_Q1_bracket_is_kept_between_scales(spark, blobs):
    knn = N.exact_knn(frame(spark, blobs), 30)
    kept = A.mixture(knn, [3.0, 10.0])
    fresh = A.mixture(knn, [3.0, 10.0], shared_bracket=False).withColumnRenamed("p", "q")
    gap = kept.join(fresh, ["i", "j"]).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert 0 <= gap < 1


def test_T13_uniform_values_T10_sigma_T9_limits(spark, blobs):
    knn = N.exact_knn(frame(spark, blobs), 6)
    assert A.uniform(knn, "mean").select("p").distinct().count() == 2
    assert A.uniform(knn, "max").select("p").distinct().count() == 1
    assert A.uniform(knn, "none").count() == 720
    assert A.fixed_sigma(knn, 1.0).agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert A.effective_perplexity(140, 90) == 30 and A.n_neighbors(91, 140) == 90
    assert A.check_perplexities([5, 50, 70], 91) == [5, 30]
    for bad in (lambda: A.effective_perplexity(0, 3), lambda: A.uniform(knn, "x"), lambda: A.limit_neighbors(knn, 30, 6)):
        with pytest.raises(ValueError):
            bad()


def test_T2_forest_leaves_and_recall(spark):
    """Leaves keep their size although a sixth of the rows are equal; levels in Spark and in tasks give like recall."""
    x = np.random.default_rng(3).normal(0, 1, (600, 8))
    x[:100] = x[0]
    pts = frame(spark, x)
    truth = N.exact_knn(pts, 10).filter("i >= 100").persist()
    for task_rows in (None, 150):
        made = Forest.build(pts, trees=8, k=10, leaf_rows=40, task_rows=task_rows)
        sizes = [r["count"] for r in made.leaves.groupBy("tree", "cell", "leaf").count().collect()]
        assert max(sizes) <= 40 and sum(sizes) == 8 * 600 and (made.levels > 1) == (task_rows is not None)
        found = made.own(10)
        assert N.recall(found.filter("i >= 100"), truth).first()[0] > 0.85 and found.filter("i = j").count() == 0
        assert found.filter("i < 100").agg(F.max("d")).first()[0] == 0
    again = Forest.build(pts.repartition(5), trees=8, k=10, leaf_rows=40, task_rows=150).own(10)
    assert got(again) == got(found)
    more = Forest.build(pts, trees=16, k=10, leaf_rows=40).own(10)
    assert N.recall(more, truth).first()[0] > N.recall(Forest.build(pts, trees=2, k=10, leaf_rows=40).own(10), truth).first()[0]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_T2_J7_new_rows_ask_the_stored_forest(spark, metric, monkeypatch):
    monkeypatch.setattr(forest, "QUERY_ROWS", 16)  # crowded leaves are dealt over several tasks
    rng = np.random.default_rng(5)
    x, new = rng.normal(0, 1, (500, 8)), rng.normal(0, 1, (120, 8))
    new[:40] = x[7]
    made = Forest.build(frame(spark, x), metric, k=5, task_rows=200)
    found, truth = made.query(frame(spark, new, 1000), 5), N.query_knn(frame(spark, x), frame(spark, new, 1000), 5, metric)
    assert N.recall(found, truth).first()[0] > 0.9 and found.count() == 600
    assert {r["j"] for r in found.filter("i < 1040 and rk = 1").collect()} == {7}
    with pytest.raises(ValueError):
        made.query(frame(spark, new), 501)


def test_T3_descent_improves_over_rounds(spark):
    x = np.random.default_rng(4).normal(0, 1, (500, 12))
    x[:60] = x[0]
    pts = frame(spark, x)
    truth = N.exact_knn(pts, 10).filter("i >= 60").persist()
    made = Forest.build(pts, trees=2, k=10, leaf_rows=30)
    start = made.own(10).persist()
    best, changed = descent.descend(start, N._prepare(pts, made.space), 10, made.space)
    before, after = (N.recall(t.filter("i >= 60"), truth).first()[0] for t in (start, best))
    assert before < 0.6 and after > 0.93 and len(changed) > 2 and changed[-1] < changed[0] / 20
    ranks = best.groupBy("i").agg(F.count("j").alias("c"), F.countDistinct("j").alias("u"), F.max("rk").alias("m")).select("c", "u", "m").distinct()
    assert [tuple(r) for r in ranks.collect()] == [(10, 10, 10)]


def test_T3_hubs_are_sampled(spark):
    lists = spark.range(5000).selectExpr("CAST(7 AS BIGINT) AS v", "id AS u", "id % 2 = 0 AS fresh", "1 AS way")
    got_ = descent._sampled(lists, 6, 0).groupBy("fresh").count().collect()
    assert sorted(tuple(r) for r in got_) == [(False, 6), (True, 6)]


def test_T6_neighbour_table_or_index_as_input(spark, blobs):
    pts = frame(spark, blobs)
    knn = N.exact_knn(pts, 15).persist()
    plain = S.Affinities.build(pts, perplexity=5, method="exact")
    table = S.Affinities.build(None, perplexity=5, neighbours=knn.select("i", "j", "d"))
    assert sorted(map(tuple, table.p.collect())) == sorted(map(tuple, plain.p.collect()))
    with pytest.raises(TypeError):
        table.to_new(pts)
    with pytest.raises(ValueError):
        S.Affinities.build(None, perplexity=10, neighbours=knn)  # needs 30 a row
    index = Forest.build(pts, k=15)
    by_index = S.Affinities.build(None, perplexity=5, index=index)
    assert by_index.n == 120 and by_index.to_new(frame(spark, blobs[:5], 900))[1].count() == 75
    with pytest.raises(ValueError):
        S.Affinities.build(None, neighbours=knn, index=index)


def _mass_rows(rng, n=40, d=7):
    x = rng.integers(0, 4, (n, d)).astype(float)  # ties and empty entries
    x[0] = 0.0
    x[1] = 5.0
    return x


def test_X6_ranks_share_ties():
    assert metrics.average_ranks(np.array([[3.0, 1.0, 3.0, 2.0], [5.0, 5.0, 5.0, 5.0]])).tolist() == [[3.5, 1.0, 3.5, 2.0], [2.5] * 4]
    assert metrics.spearmanr(np.array([1.0, 2.0, 9.0]), np.array([0.0, 5.0, 6.0])) == pytest.approx(0.0)
    assert metrics.spearmanr(np.array([1.0, 2.0, 9.0]), np.array([8.0, 5.0, 2.0])) == pytest.approx(2.0)


def test_X6_transport_on_a_line_a_circle_and_between_far_places():
    a, b = np.array([2.0, 0, 0, 0, 0, 0]), np.array([0, 0, 0, 0, 0, 1.0])
    assert metrics.wasserstein_1d(a, b) == pytest.approx(5.0)
    assert metrics.circular_kantorovich(a, b) == pytest.approx(1.0)  # one step the other way round
    line = np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0)))
    assert metrics.sinkhorn(a, b, cost=line) == pytest.approx(5.0)  # a single source and target leave no choice
    near = metrics.sinkhorn(np.array([1.0, 1, 0, 0]), np.array([0.0, 1, 1, 0]), cost=line[:4, :4], regularization=0.02, rounds=2000)
    assert near == pytest.approx(1.0, abs=0.02)


def test_X6_divergences_and_bits():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert metrics.jensen_shannon(p, q) == pytest.approx(0.5 * np.log(2), abs=1e-5)
    assert metrics.symmetric_kl(p, p) == 0 and metrics.symmetric_kl(p, q) > 10
    a, b = np.array([255.0, 0, 6]), np.array([15.0, 0, 3])
    assert metrics.bit_hamming(a, b) == 6 and metrics.bit_jaccard(a, b) == pytest.approx(6 / 11)
    assert metrics.bit_jaccard(a * 0, b * 0) == 0


@pytest.mark.parametrize("metric", [
    "spearmanr", "tsss", "wasserstein_1d", "circular_kantorovich", "sinkhorn", "jensen-shannon", "symmetric_kl", "bit_hamming", "bit_jaccard",
])
def test_X6_neighbours_equal_brute_force(spark, metric):
    x = _mass_rows(np.random.default_rng(4))
    found = N.exact_knn(frame(spark, x), 4, metric, block_rows=12)
    _, fn = metrics.resolve(metric)
    d = np.array([[float(fn(p, q)) for q in x] for p in x])
    np.fill_diagonal(d, np.inf)
    for r in found.collect():  # places of equal distances may differ in the last bit
        assert r["d"] == pytest.approx(d[r["i"], r["j"]], abs=1e-9) and r["d"] == pytest.approx(np.sort(d[r["i"]])[r["rk"] - 1], abs=1e-9)
    assert found.count() == 4 * len(x)
