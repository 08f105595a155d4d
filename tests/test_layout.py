import numpy as np
import pytest
from pyspark.sql import functions as F

from trefoil.functions import layout as L
from trefoil.operators import affinity as A
from trefoil.operators import convolve as C
from trefoil.operators import gradient as D
from trefoil.operators import initial as I
from trefoil.operators import neighbors as N
from trefoil.operators import placing as B
from trefoil.operators import tsne as S
from trefoil.operators.cells import CellTree
from trefoil.session import cut_lineage


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def places(spark, y):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)],
                                 "id long, " + ", ".join(f"y{c} double" for c in range(y.shape[1])))


def exact(y, dof=1.0):
    gap = y[:, None] - y[None]
    q, w = L.student((gap ** 2).sum(-1), dof)
    np.fill_diagonal(q, 0)
    np.fill_diagonal(w, 0)
    return q.sum(1), (w[..., None] * gap).sum(1)


def forces(df, dims):
    rows = df.orderBy("id").collect()
    return np.array([r["z"] for r in rows]), np.array([[r[f"f{c}"] for c in range(dims)] for r in rows])


@pytest.mark.parametrize("dims, dof", [(1, 1.0), (2, 0.8), (3, 1.0)])
def test_T19_tree_with_all_cells_open_is_exact(spark, dims, dof):
    y = np.random.default_rng(0).normal(0, 5, (300, dims))
    y[10:60] = y[9]  # one place holds more rows than a tile
    z, f = forces(D.tree_repulsion(places(spark, y), dims, 0.0, dof, tile_rows=20), dims)
    want_z, want_f = exact(y, dof)
    assert np.allclose(z, want_z, atol=1e-9) and np.allclose(f, want_f, atol=1e-9)


def test_T19_tree_and_T20_grid_are_close(spark):
    y = np.random.default_rng(1).normal(0, 3, (400, 2))
    at = places(spark, y)
    want_z, want_f = exact(y)
    size = np.linalg.norm(want_f)
    found = {
        "tree": D.tree_repulsion(at, 2, 0.5), "small tiles": D.tree_repulsion(at, 2, 0.5, tile_rows=9),
        "grid": D.grid_repulsion(at, 2, L.make_grid(y.min(0), y.max(0))),
    }
    got = {k: forces(v, 2) for k, v in found.items()}
    for name, (z, f) in got.items():
        assert np.linalg.norm(f - want_f) / size < 0.05
        assert z.sum() == pytest.approx(want_z.sum(), rel=1e-3 if name == "grid" else 1e-2)
    assert np.allclose(got["tree"][1], got["small tiles"][1], atol=1e-9)  # tiles change nothing
    assert np.allclose(forces(D.exact_repulsion(at, 2, 1.0, 90), 2)[0], want_z)
    with pytest.raises(ValueError):
        D.grid_repulsion(at, 3, L.make_grid([0, 0, 0], [1, 1, 1]))


def test_T19_one_place_and_one_row(spark):
    z, f = forces(D.tree_repulsion(places(spark, np.ones((50, 2))), 2, tile_rows=20), 2)
    assert np.allclose(z, 49) and not f.any()
    z, f = forces(D.tree_repulsion(places(spark, np.ones((1, 2))), 2), 2)
    assert z.tolist() == [0.0] and not f.any()


@pytest.mark.parametrize("dims, dof", [(1, 1.0), (2, 0.8)])
def test_T20_transform_in_passes_equals_node_sums(spark, dims, dof):
    y = np.random.default_rng(2).normal(0, 4, (60, dims))
    grid = L.make_grid(y.min(0), y.max(0))
    node, charge = L.grid_charges(grid, y)
    place = np.stack(np.unravel_index(np.arange(np.prod(grid.shape)), grid.shape), 1) * grid.width / grid.points
    q, w = L.student(((place[:, None] - place[None, node]) ** 2).sum(-1), dof)
    want = np.vstack([(w @ charge).T, (q @ charge[:, 0])[None]]).reshape(dims + 2, *grid.shape)
    got = np.zeros_like(want)
    boxes = 0
    for r in C.potentials(places(spark, y), dims, grid, dof).collect():
        span = tuple(slice(b * grid.points, (b + 1) * grid.points) for b in r["box"])
        got[(slice(None), *span)] = np.array(r["phi"]).reshape(dims + 2, *(grid.points,) * dims)
        boxes += 1
    assert boxes == np.prod(grid.boxes) and np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("method", ["bh", "fft"])
def test_T21_regions_change_no_placement(spark, method, monkeypatch):
    """Rows that cross regions and a crowded region move as they do all at once."""
    rng = np.random.default_rng(6)
    y, new = rng.normal(0, 4, (60, 2)), rng.normal(0, 4, (80, 2))
    new[:30] = new[0]
    refs, weights = rng.normal(0, 4, (80, 3, 2)), np.full((80, 3), 1 / 3)
    rows = [(i, *map(float, r), 0.0, 0.0, 1.0, 1.0, list(map(float, w)), list(map(float, at.ravel())))
            for i, (r, w, at) in enumerate(zip(new, weights, refs))]
    start = spark.createDataFrame(rows, "id long, y0 double, y1 double, u0 double, u1 double, g0 double, g1 double, "
                                        "weights array<double>, places array<double>")
    if method == "bh":
        source, limit = B.TreeField(CellTree.build(places(spark, y), 2), 0.0, 1.0), None
        sample = lambda at: exact_field(y, at)
    else:
        monkeypatch.setattr(B, "REGION_BOXES", 5)
        monkeypatch.setattr(B, "MARGIN_BOXES", 2)
        grid = L.make_grid([-20, -20], [20, 20])
        boxes = cut_lineage(C.potentials(places(spark, y), 2, grid, 1.0))
        source, limit = B.GridField(grid, boxes, 2), (-20.0, 20.0)
        field = {tuple(r["box"]): np.array(r["phi"]) for r in boxes.collect()}

        def sample(at):
            got = L.weigh_nodes(grid, np.stack([field[tuple(b)] for b in L.box_of(grid, at)]), at)
            return got[:, 3], at * got[:, :1] - got[:, 1:3]
    plan = L.NewRows(2.0, 1.5, 0.8, 0.01, None, None, 5, 1.0, limit, False)
    want_y, _, want_g, _ = L.descend_rows(new, np.zeros((80, 2)), np.ones((80, 2)), weights, refs, sample, plan)
    got = B.place(start, source, plan, tile_rows=8).orderBy("id").collect()
    assert len(got) == 80 and np.abs(want_y - new).max() > 1
    assert np.allclose([[r["y0"], r["y1"]] for r in got], want_y, atol=1e-6)
    assert np.allclose([[r["g0"], r["g1"]] for r in got], want_g, atol=1e-6)
    assert np.allclose([r["z"] for r in got], sample(want_y)[0], atol=1e-6)


def exact_field(y, at):
    gap = at[:, None] - y[None]
    q, w = L.student((gap ** 2).sum(-1), 1.0)
    return q.sum(1), (w[..., None] * gap).sum(1)


def test_box_counts_are_fft_friendly():
    assert [L.good_boxes(x) for x in (1, 23, 29, 34, 51, 101, 999, 5000)] == [20, 24, 30, 35, 52, 104, 1000, 1000]


def test_F11_disc_clip_and_F9_F10():
    y, out = L.clip_to_disc(np.array([[3.0, 4.0], [0.1, 0.0]]), 1.0)
    assert np.allclose(y, [[0.6, 0.8], [0.1, 0.0]]) and out.tolist() == [True, False]
    _, u, g = L.advance(np.zeros((1, 2)), np.zeros((1, 2)), np.ones((1, 2)), np.array([[30.0, 40.0]]), 1.0, 0.8, 0.01,
                        None, 5.0)
    assert np.allclose(u, [[-3.0, -4.0]]) and np.allclose(g, 1.2)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 1, (50, 4)) for c in (-4, 0, 4)])
    return x, np.repeat([0, 1, 2], 50)


def test_T23_fused_step_equals_column_step(spark, blobs):
    x, _ = blobs
    p = cut_lineage(A.uniform(N.exact_knn(frame(spark, x), 8), "mean"))
    start = cut_lineage(D.start_layout(places(spark, np.random.default_rng(0).normal(0, 1, (150, 2))), 2))
    s = D.Settings(method="fft", exaggeration=4.0)
    by_grid = lambda layout, dims, s: D.repelled(layout, dims, s.with_(method="fft")).select("id", "z", "f0", "f1")
    fast = D.descend(start, p, 2, 150, 2, s).orderBy("id").collect()
    slow = D.descend(start, p, 2, 150, 2, s.with_(method=by_grid)).orderBy("id").collect()
    assert np.allclose([list(r)[1:] for r in fast], [list(r)[1:] for r in slow], atol=1e-6)
    assert abs(np.mean([r["y0"] for r in fast])) < 1e-9
    tree, exact_ = (D.descend(start, p, 2, 150, 1, s.with_(method=m, theta=0.0)).orderBy("id").collect() for m in ("bh", "exact"))
    assert np.allclose([list(r)[1:] for r in tree], [list(r)[1:] for r in exact_], atol=1e-6)


def test_T25_fit_separates_and_T26_transform_places(spark, blobs):
    x, label = blobs
    seen = []

    def watch(iteration, error, layout):
        seen.append((iteration, error))
        return False

    model = S.TSNE(perplexity=10, early_exaggeration_iter=14, n_iter=4, callbacks=[watch], callbacks_every_iters=10)
    emb = model.fit(frame(spark, x))
    y = np.array([[r["y0"], r["y1"]] for r in emb.positions.orderBy("id").collect()])
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :10]
    assert np.mean([np.bincount(label[n], minlength=3).argmax() == t for n, t in zip(near, label)]) > 0.94
    assert seen[0][0] == 10 and emb.kl_divergence == pytest.approx(
        S.kl_divergence(emb.positions, emb.p, 2, "auto", min_num_intervals=50), abs=1e-9)
    assert emb.pbic() > 0
    new = x[::10] + 0.01
    for method in ("bh", "fft"):
        part = emb.transform(frame(spark, new, 1000), method=method, n_iter=60)
        z = np.array([[r["y0"], r["y1"]] for r in part.positions.orderBy("id").collect()])
        mid = (y.max(0) + y.min(0)) / 2
        assert part.kl_divergence is not None
        hits = np.argmin(((z[:, None] - (y - mid)[None]) ** 2).sum(-1), 1)
        assert np.mean(label[hits] == label[::10]) > 0.9
    one = emb.transform(frame(spark, new[:1], 1000), method="bh", n_iter=60).positions.first()
    all_ = emb.transform(frame(spark, new, 1000), method="bh", n_iter=60).positions.filter("id = 1000").first()
    assert np.allclose(list(one)[1:], list(all_)[1:], atol=1e-7)


def test_T28_interrupt_returns_layout(spark, blobs):
    model = S.TSNE(perplexity=10, early_exaggeration_iter=3, n_iter=3, initialization="random",
                   callbacks=[lambda i, e, y: True], callbacks_every_iters=2)
    emb = model.fit(frame(spark, blobs[0]))
    assert emb.positions.count() == 150 and emb.kl_divergence is not None


def test_T27_callbacks_of_new_rows(spark, blobs):
    """Turns, stored divergence, and a stop after the second turn; stages change no position."""
    model = S.TSNE(perplexity=10, early_exaggeration_iter=2, n_iter=1)
    emb = model.fit(frame(spark, blobs[0]))
    part = emb.prepare_partial(frame(spark, blobs[0][:5] + 0.01, 1000), k=5, perplexity=4)
    seen = []

    def watch(iteration, error, layout):
        seen.append((iteration, error, layout.count()))
        return iteration == 6

    stopped = part.optimize(20, callbacks=[watch], callbacks_every=3)
    assert [(i, n) for i, _, n in seen] == [(3, 5), (6, 5)] and stopped.kl_divergence == seen[1][1]
    plain = part.optimize(6).positions.orderBy("id").collect()
    assert np.allclose([list(r) for r in plain], [list(r) for r in stopped.positions.orderBy("id").collect()], atol=1e-9)
    with pytest.raises(D.OptimizationInterrupt):
        part.optimize(9, callbacks=[lambda *a: True], callbacks_every=3, propagate=True)
    rows = part.p.collect()
    ref = {r["id"]: np.array([r["y0"], r["y1"]]) for r in part.reference.collect()}
    at = {r["id"]: np.array([r["y0"], r["y1"]]) for r in stopped.positions.collect()}
    total = sum(exact_field(np.array(list(ref.values())), y[None])[0][0] for y in at.values())
    want = sum(r["p"] * np.log(r["p"] * (1 + ((at[r["i"]] - ref[r["j"]]) ** 2).sum()) * total) for r in rows)
    assert stopped.kl_divergence == pytest.approx(want, rel=1e-2)


def test_T28_T29_callback_classes_and_wrapper(spark, blobs):
    pts = frame(spark, blobs[0])
    emb = S.TSNE(perplexity=10, early_exaggeration_iter=2, n_iter=1).fit(pts)
    errors, verify = S.ErrorApproximations(emb), S.VerifyExaggerationError(emb)
    emb.optimize(2, exaggeration=4.0, callbacks=[errors, verify], callbacks_every=2)
    report = errors.report()
    assert abs(report["bh_mean"]) < 0.01 and abs(report["fft_mean"]) < 0.01 and report["bh_std"] == 0
    with pytest.raises(RuntimeError):
        verify(1, 123.0, emb.layout)
    wrapper = S.TSNETransformer(perplexity=10, early_exaggeration_iter=2, n_iter=1)
    with pytest.raises(ValueError):
        wrapper.transform(pts)
    first = wrapper.fit_transform(pts)
    assert first.columns == ["id", "y0", "y1"] and first.count() == 150
    assert wrapper.transform(frame(spark, blobs[0][:4] + 0.01, 900), n_iter=2).count() == 4


def test_T17_small_gap_and_no_convergence(spark):
    """A long path has a walk with a tiny gap; the residual bound still holds."""
    n = 120
    edges = [(i, j, 1.0) for a in range(n - 1) for i, j in ((a, a + 1), (a + 1, a))]
    p = spark.createDataFrame(edges, "i long, j long, p double")
    y = np.array([r["y0"] for r in I.spectral(p, 1, add_jitter=False).orderBy("id").collect()])
    want = np.cos(np.pi * np.arange(n) / (n - 1))
    assert abs(np.corrcoef(y, want)[0, 1]) > 0.99999
    with pytest.raises(RuntimeError):
        I.spectral(p, 1, tolerance=1e-12, steps=2, max_restarts=1)


def test_T15_T16_T18_initial_positions(spark, blobs):
    x, _ = blobs
    pts = frame(spark, x)
    got = I.pca(pts, 2, add_jitter=False).orderBy("id").collect()
    y = np.array([list(r)[1:] for r in got])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (u * s)[:, :2]
    assert abs(np.corrcoef(y[:, 0], want[:, 0])[0, 1]) == pytest.approx(1, abs=1e-9)
    assert y[:, 0].std() == pytest.approx(1e-4)
    r1, r2 = (sorted(map(tuple, I.random(pts.repartition(k), 2, 3).collect())) for k in (2, 5))
    assert r1 == r2 and abs(np.std([r[1] for r in r1]) / 1e-4 - 1) < 0.2
    knn = spark.createDataFrame([(9, 0, 1.0, 1), (9, 1, 3.0, 2)], "i long, j long, d double, rk int")
    ref = places(spark, np.array([[0.0, 0.0], [4.0, 8.0]]))
    assert list(I.neighbor_median(knn, ref, 2, 2).first()) == [9, 2.0, 4.0]
    assert list(I.neighbor_weighted(knn, ref, 2, 2).first()) == [9, 3.0, 6.0]


def test_T17_spectral_matches_eigenvectors(spark, blobs):
    x, _ = blobs
    p = cut_lineage(A.uniform(N.exact_knn(frame(spark, x), 60), "mean"))
    m = np.zeros((150, 150))
    for r in p.collect():
        m[r["i"], r["j"]] = r["p"]
    w = 1 / np.sqrt(m.sum(1))
    val, vec = np.linalg.eigh(m * w[:, None] * w[None])
    want = (vec * w[:, None])[:, ::-1][:, 1]
    y = np.array([list(r)[1:] for r in I.spectral(p, 1, add_jitter=False).orderBy("id").collect()])
    assert abs(np.corrcoef(y[:, 0], want)[0, 1]) > 0.9999


def test_T9b_set_perplexity_and_T14(spark, blobs):
    aff = S.Affinities.build(frame(spark, blobs[0]), perplexity=10)
    assert aff.set_perplexity(10) is aff
    small = aff.set_perplexity(5)
    assert small.k == 15 and small.p.agg(F.sum("p")).first()[0] == pytest.approx(1)
    one_way = S.Affinities.build(frame(spark, blobs[0]), perplexity=10, symmetrize=False).set_perplexity(5)
    assert one_way.p.groupBy("i").count().agg(F.min("count"), F.max("count")).first() == (15, 15)
    with pytest.raises(ValueError):
        aff.set_perplexity(20)
    with pytest.raises(TypeError):
        S.Affinities(A.precomputed(aff.p)).to_new(frame(spark, blobs[0]))
    with pytest.raises(TypeError):
        S.Affinities(aff.p).perplexity


def test_T11_scales_and_to_new_options(spark, blobs):
    x = blobs[0]
    model = S.TSNE(perplexity=[5, 10], initialization="random", negative_gradient_method="exact", early_exaggeration_iter=0, n_iter=1)
    emb = model.fit(frame(spark, x))
    assert emb.affinities.kind == "mixture" and emb.affinities.perplexities == [5, 10] and emb.affinities.k == 30
    small = emb.affinities.set_perplexities([4, 6])
    assert small.perplexities == [4, 6] and small.k == 18 and small.p.agg(F.sum("p")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        emb.affinities.set_perplexities([40])
    few = S.Affinities.build(frame(spark, x[:40]), "mixture", perplexity=30)
    assert few.perplexities == [13] and few.perplexity == 13
    new = frame(spark, x[:6] + 0.01, 1000)
    assert few.to_new(new, 500)[1].groupBy("i").count().agg(F.max("count")).first()[0] == 39
    even = S.Affinities.build(frame(spark, x), "uniform", k=8)
    assert even.to_new(new, k=3)[0].agg(F.count("p"), F.sum("p")).first() == (18, pytest.approx(6))
    wide = S.Affinities.build(frame(spark, x), "fixed_sigma", k=8, sigma=1.0)
    near, far = (wide.to_new(new, sigma=s)[0].agg(F.max("p")).first()[0] for s in (None, 100.0))
    assert near > far and far == pytest.approx(1 / 8, rel=1e-2)
    # New rows follow the model's gradient method.
    def moved(method):
        rows = emb.transform(new, method=method, n_iter=3).positions.orderBy("id").collect()
        return np.array([list(r)[1:] for r in rows])

    own = moved("auto")
    assert np.allclose(own, moved("exact"), rtol=1e-9, atol=0) and not np.allclose(own, moved("fft"), rtol=1e-9, atol=0)


@pytest.mark.parametrize("theta, branch", [(0.0, 256), (0.5, 32), (0.5, 8)])
def test_branches_of_the_tree_travel_packed(spark, monkeypatch, theta, branch):
    """Every cell that a tile may open was a row of its own, written and shuffled."""
    from trefoil.operators import cells as C

    monkeypatch.setattr(C, "BRANCH", branch)
    y = np.random.default_rng(4).normal(0, 3, (400, 2))
    y[350:] = y[0]
    tree = CellTree.build(places(spark, y), 2, tile_rows=50)
    rows = tree.essential(tree.tiles, theta)
    large, small = tree._opened(tree.tiles, theta, branch)
    assert large.count() + small.count() < 0.6 * rows.count()
    z = {r["id"]: (r["z"], r["f0"], r["f1"]) for r in tree.repulsion(places(spark, y), theta).collect()}
    part = tree.part(rows.drop("tile").distinct().toPandas())
    fine = {r["id"]: r["f"] for r in places(spark, y).select("id", C.cell_name([F.col("y0"), F.col("y1")], list(tree.low), tree.side, tree.depth).alias("f")).collect()}
    want, force = L.walk_cells(part, y, theta, 1.0, np.array([fine[i] for i in range(400)]), tree.depth)
    assert np.allclose([z[i] for i in range(400)], np.column_stack([want, force]))
