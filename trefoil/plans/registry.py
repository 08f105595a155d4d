"""Every registered query: ``name -> callable(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.functions import layout as L
from trefoil.operators import affinity as A
from trefoil.operators import enumerate as U
from trefoil.operators import enrichment as E
from trefoil.operators import graph as G
from trefoil.operators import gradient as D
from trefoil.operators import initial as I
from trefoil.operators import neighbors as N
from trefoil.operators import orbits as O
from trefoil.operators import ranking as R
from trefoil.operators import tsne as S
from trefoil.operators.forest import Forest
from trefoil.operators.sparse import sparse_knn
from trefoil.session import written
from trefoil.sources import tables as T

K_GRAPH = 4
K_NEAR = 10
PERPLEXITY = 10.0
SCALES = [5.0, 10.0]
SIGMA = 0.5
# Stretch of the two features used as fixed positions by the gradient queries.
STRETCH = 20.0


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# -- enrichment ------------------------------------------------------------------------------


def _expr(spark: SparkSession, sf: str, gene: str = "p_partkey") -> DataFrame:
    """The derived matrix, kept because ranking and its checks read it more than once."""
    return T.expression(spark, sf, gene).persist()


def _enrich(**options):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _r(E.score(_expr(spark, sf), T.gene_sets(spark, sf), **options), "score")

    return run


def ssgsea_walk(spark, sf):
    return _r(E.score_by_walk(_expr(spark, sf), T.gene_sets(spark, sf)), "score")


def ssgsea_gsva(spark, sf):
    return _r(E.score_gsva(_expr(spark, sf), T.gene_sets(spark, sf), normalize=True), "score")


def ssgsea_bucketed(spark, sf):
    """The path for samples too large for one task, run on every sample."""
    ranked = R.rank_rows(E.finite_expression(_expr(spark, sf)), strategy="bucketed", max_window_rows=500)
    return ranked.select("sample", "row_idx", "q", F.round("avg_rank", 6).alias("avg_rank"))


def ssgsea_prefix(spark, sf):
    ex, sets = _expr(spark, sf), T.gene_sets(spark, sf)
    names = E.set_prefix(E.qualifying_sets(sets, ex, 4, 10_000), 10)
    # Larger tables may have no set within the limits: then the answer has no rows.
    return _r(E.score(ex, sets.join(names, "set_name", "left_semi"), no_sets="empty"), "score")


def ssgsea_matrix(spark, sf):
    """The matrix as one map a sample, so that the set names needn't reach the driver."""
    scores = _r(E.score(_expr(spark, sf), T.gene_sets(spark, sf, "p_type")), "score")
    return scores.groupBy("sample").agg(F.to_json(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("set_name", F.col("score").cast("decimal(20,6)")))))).alias("scores"))


def ssgsea_checksum(spark, sf):
    got = E.checksum(E.score(_expr(spark, sf), T.gene_sets(spark, sf)))
    return _r(got, "checksum", digits=4)


def avg_rank(spark, sf):
    ranked = R.rank_rows(E.finite_expression(_expr(spark, sf)))
    return ranked.select("sample", "row_idx", "avg_rank")


def stable_ordinal(spark, sf):
    return R.rank_rows(E.finite_expression(_expr(spark, sf))).select("sample", "row_idx", "q")


def dup_mean(spark, sf):
    return _r(E.average_duplicates(_expr(spark, sf, "p_brand")), "value")


def set_overlap(spark, sf):
    return E.qualifying_sets(T.gene_sets(spark, sf), _expr(spark, sf), 15, 500)


def _bought(spark, sf):
    """Expression rows of parts actually sold, so that alignment has something to drop."""
    return _expr(spark, sf).filter(F.col("value") > 0)


def align_sets(spark, sf):
    _, kept = E.align(_bought(spark, sf), T.gene_sets(spark, sf))
    return kept.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_genes"))


def align_expression(spark, sf):
    by_type = T.gene_sets(spark, sf, "p_type")
    rows, _ = E.align(_bought(spark, sf), by_type)
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))


# -- neighbours --------------------------------------------------------------------------------


def _near(metric: str, k: int = K_NEAR):
    def run(spark, sf):
        return _r(N.exact_knn(T.points(spark, sf), k, metric), "d")

    return run


def _split(spark, sf):
    """Known labels (2 and up) are the reference, the others ask; every vector is used."""
    pts = T.points(spark, sf)
    return pts.filter(F.col("label") >= 2), pts.filter(F.col("label") < 2)


def knn_query(spark, sf):
    reference, asking = _split(spark, sf)
    return _r(N.query_knn(reference, asking, K_NEAR), "d")


def _near_as(metric: str, made):
    """Neighbours of rows whose entries ``made`` turns into masses or bytes."""
    def run(spark, sf):
        pts = T.points(spark, sf).withColumn("features", F.transform("features", made))
        return _r(N.exact_knn(pts, K_NEAR, metric), "d")

    return run


def knn_pruned(spark, sf):
    """The block join with pivots and pruning, on blocks small enough to need it."""
    return _r(N.exact_knn(T.points(spark, sf), K_NEAR, block_rows=100), "d")


def knn_precomputed(spark, sf):
    """A table of all distances is the input."""
    return _r(N.precomputed_knn(N.all_distances(T.points(spark, sf), wide=True), K_NEAR), "d")


def _sparse(metric: str):
    """All customers, those who bought nothing too, by the parts they bought."""
    def run(spark, sf):
        ids = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
        return _r(sparse_knn(T.baskets(spark, sf), K_NEAR, metric, ids), "d")

    return run


def ann_recall(spark, sf):
    pts = T.points(spark, sf)
    found = N.approx_knn(pts, K_NEAR, block_rows=64)
    return N.recall(found, N.exact_knn(pts, K_NEAR))


def _recalled(spark, found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Rows found, whether each row has all its k, whether every distance is right, and whether recall reaches 0.9."""
    right = found.join(truth.select("i", "j", F.col("d").alias("t")), ["i", "j"], "left")
    share = F.count("t") / F.lit(truth.count())
    full = found.groupBy("i").agg(F.count(F.lit(1)).alias("c")).agg(F.min(F.col("c") == k).alias("full"))
    told = right.agg(F.count(F.lit(1)).alias("n_found"), (F.max(F.abs(F.col("d") - F.col("t"))) < 1e-9).alias("same_distances"),
                     (share >= 0.9).alias("recall_reached"))
    return told.join(F.broadcast(full))  # one row each


def forest_recall(spark, sf):
    """The projection forest against the exact join."""
    pts = T.points(spark, sf)
    return _recalled(spark, Forest.build(pts, trees=16, k=K_NEAR).own(K_NEAR).persist(), N.exact_knn(pts, K_NEAR).persist(), K_NEAR)


def forest_query_recall(spark, sf):
    """New rows ask the stored forest."""
    reference, asking = _split(spark, sf)
    found = Forest.build(reference, k=K_NEAR).query(asking, K_NEAR)
    return _recalled(spark, found.persist(), N.query_knn(reference, asking, K_NEAR).persist(), K_NEAR)


def descent_recall(spark, sf):
    """Neighbour descent from two trees against the exact join."""
    pts = T.points(spark, sf)
    return _recalled(spark, N.descent_knn(pts, K_NEAR).persist(), N.exact_knn(pts, K_NEAR).persist(), K_NEAR)


# -- graphs -------------------------------------------------------------------------------------


def _graph(spark, sf) -> DataFrame:
    """Kept, because every query reads it more than once and the exact join behind it is the larger part."""
    return written(G.clean_edges(N.symmetric_graph(N.exact_knn(T.points(spark, sf), K_GRAPH))))


def _nodes(spark, sf) -> DataFrame:
    return T.points(spark, sf).select(F.col("id").alias("v"))


def _bipartite(spark, sf) -> DataFrame:
    """Suppliers and parts on even and odd ids."""
    li = T.table(spark, sf, "lineitem")
    return G.clean_edges(
        li.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    )


def graph_normalise(spark, sf):
    """Both neighbour directions, repeats included, reduced to distinct undirected edges."""
    knn = N.exact_knn(T.points(spark, sf), K_GRAPH)
    both = knn.select(F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(
        knn.select(F.col("j").alias("src"), F.col("i").alias("dst"))
    )
    return G.clean_edges(both).select("x", "y")


def degree(spark, sf):
    return G.degrees(_graph(spark, sf), _nodes(spark, sf))


def degree_hist(spark, sf):
    return G.degree_histogram(_graph(spark, sf), _nodes(spark, sf))


def bipartite_degree(spark, sf):
    return G.degrees(_bipartite(spark, sf))


def bipartite_squares(spark, sf):
    squares = G.edge_squares(G.with_degrees(_bipartite(spark, sf)))
    return squares.select("x", "y", "squares")


def edge_triangles(spark, sf):
    return G.edge_triangles(_graph(spark, sf))


def codegree(spark, sf):
    return G.codegrees(_graph(spark, sf))


def _cliques(size: int):
    def run(spark, sf):
        return G.node_cliques(_graph(spark, sf), size, _nodes(spark, sf))

    return run


def orbits4_nodes(spark, sf):
    return O.OrbitCounts(_graph(spark, sf), _nodes(spark, sf), 4).node_orbits()


def orbits4_edges(spark, sf):
    return O.OrbitCounts(_graph(spark, sf), None, 4).edge_orbits().drop("edge_id")


def orbits5_nodes(spark, sf):
    return O.OrbitCounts(_graph(spark, sf), _nodes(spark, sf), 5).node_orbits()


def orbits5_edges(spark, sf):
    return O.OrbitCounts(_graph(spark, sf), None, 5).edge_orbits().drop("edge_id")


def orbits4_enumerated(spark, sf):
    """The listing join, as an independent way to the same counts."""
    return U.enumerated_node_orbits(_graph(spark, sf), _nodes(spark, sf), 4)


def graphlet_totals(spark, sf):
    return O.graphlet_totals(orbits5_nodes(spark, sf), 5)


def orbit_histogram(spark, sf):
    return O.orbit_histogram(orbits4_nodes(spark, sf), 4)


# -- affinities ------------------------------------------------------------------------------------


def _knn(spark, sf, k: int) -> DataFrame:
    return N.exact_knn(T.points(spark, sf), k).persist()


def _affinity(make, k: int = int(3 * PERPLEXITY)):
    def run(spark, sf):
        return _r(make(_knn(spark, sf, k)), "p", digits=9)

    return run


def to_new_p(spark, sf):
    reference, asking = _split(spark, sf)
    return _r(A.to_new(N.query_knn(reference, asking, 15), [5.0]), "p", digits=7)


# -- starting positions -----------------------------------------------------------------------------


def _positions(spark, sf) -> DataFrame:
    f = F.col("features")
    return T.points(spark, sf).select(
        "id", (f[0] * STRETCH).alias("y0"), (f[1] * STRETCH).alias("y1")
    )


def median_init(spark, sf):
    reference, asking = _split(spark, sf)
    return _r(I.neighbor_median(N.query_knn(reference, asking, K_NEAR), _positions(spark, sf), 2, K_NEAR), "y0", "y1")


def weighted_init(spark, sf):
    reference, asking = _split(spark, sf)
    return _r(I.neighbor_weighted(N.query_knn(reference, asking, K_NEAR), _positions(spark, sf), 2, K_NEAR), "y0", "y1")


def pca_init(spark, sf):
    return I.pca(T.points(spark, sf), 2, add_jitter=False)


def random_init(spark, sf):
    return I.random(T.points(spark, sf), 2)


def spectral_init(spark, sf):
    p = A.perplexity_based(_knn(spark, sf, 30), PERPLEXITY, 30)
    return I.spectral(p, 2)


# -- gradient ------------------------------------------------------------------------------------------


def _p(spark, sf) -> DataFrame:
    return A.uniform(_knn(spark, sf, K_NEAR), "mean")


def attraction(spark, sf):
    at = _positions(spark, sf)
    return _r(D.attraction(_p(spark, sf), at, at, 2), "at0", "at1", digits=9)


def repulsion_exact(spark, sf):
    return _r(D.exact_repulsion(_positions(spark, sf), 2), "z", "f0", "f1", digits=5)


def sum_q(spark, sf):
    forces = D.exact_repulsion(_positions(spark, sf), 2, 0.8)
    return forces.agg(F.round(F.sum("z"), 4).alias("sum_q"))


def kl_exact(spark, sf):
    kl = S.kl_divergence(_positions(spark, sf), _p(spark, sf), 2)
    return spark.range(1).select(F.round(F.lit(kl), 6).alias("kl"))


def update_step(spark, sf):
    """One exaggerated step from rest with the exact gradient."""
    s = D.Settings(method="exact", exaggeration=12.0, max_step_norm=5.0)
    start = D.start_layout(_positions(spark, sf), 2)
    n = start.count()
    rows, _ = D.gradient(start, _p(spark, sf), 2, s, n)
    return _r(D.stepped(rows, 2, s, n / 12.0), "y0", "y1", "u0", "u1").select("id", "y0", "y1", "u0", "u1", "g0", "g1")


def clip_disc(spark, sf):
    radius = 2.0
    a, b = F.col("y0"), F.col("y1")
    x, y = D.clipped([a, b], radius)
    return _r(_positions(spark, sf).select("id", x.alias("y0"), y.alias("y1")), "y0", "y1")


def bh_repulsion(spark, sf):
    got = D.tree_repulsion(_positions(spark, sf), 2, 0.5, 1.0)
    return _r(got, "z", "f0", "f1", digits=5)


def bh_exact_limit(spark, sf):
    """The tree with every cell opened is the exact sum."""
    got = D.tree_repulsion(_positions(spark, sf), 2, 0.0, 1.0)
    return _r(got, "z", "f0", "f1", digits=5)


def bh_joined(spark, sf):
    """The same tree dealt over many small tiles gives the same numbers."""
    got = D.tree_repulsion(_positions(spark, sf), 2, 0.5, 1.0, tile_rows=20)
    return _r(got, "z", "f0", "f1", digits=5)


def fft_repulsion(spark, sf):
    at = _positions(spark, sf)
    low, high = D.position_bounds(at, 2)
    got = D.grid_repulsion(at, 2, L.make_grid(low, high)).select("id", "z", "f0", "f1")
    return _r(got, "z", "f0", "f1", digits=4)


def tsne_fit(spark, sf):
    model = S.TSNE(perplexity=PERPLEXITY, early_exaggeration_iter=6, n_iter=6)
    return model.fit(T.points(spark, sf)).positions


def tsne_transform(spark, sf):
    reference, asking = _split(spark, sf)
    model = S.TSNE(perplexity=PERPLEXITY, early_exaggeration_iter=4, n_iter=2)
    return model.fit(reference).transform(asking).positions


QUERIES = {
    "ssgsea_rank": _enrich(),
    "ssgsea_walk": ssgsea_walk,
    "ssgsea_alpha1": _enrich(alpha=1.0),
    "ssgsea_alpha0": _enrich(alpha=0.0),
    "ssgsea_alpha_07": _enrich(alpha=0.7),
    "ssgsea_zscore": _enrich(profile="single_sample_gsea_0.2"),
    "ssgsea_sample_z": _enrich(normalization="sample_zscore"),
    "ssgsea_range": _enrich(normalization="global_range"),
    # Larger tables may have no set of such a size: then the answer has no rows.
    "ssgsea_sizes": _enrich(min_size=75, max_size=90, no_sets="empty"),
    "ssgsea_gsva": ssgsea_gsva,
    "ssgsea_bucketed": ssgsea_bucketed,
    "ssgsea_prefix": ssgsea_prefix,
    "ssgsea_matrix": ssgsea_matrix,
    "ssgsea_checksum": ssgsea_checksum,
    "avg_rank": avg_rank,
    "stable_ordinal": stable_ordinal,
    "dup_mean": dup_mean,
    "set_overlap": set_overlap,
    "align_sets": align_sets,
    "align_expression": align_expression,
    "knn_euclidean": _near("euclidean"),
    "knn_manhattan": _near("manhattan"),
    "knn_chebyshev": _near("chebyshev"),
    "knn_cosine": _near("cosine"),
    "knn_canberra": _near("canberra"),
    "knn_spearmanr": _near("spearmanr"),
    "knn_wasserstein_1d": _near_as("wasserstein_1d", F.abs),
    "knn_jensen_shannon": _near_as("jensen_shannon", F.abs),
    "knn_bit_hamming": _near_as("bit_hamming", lambda x: (F.floor(F.abs(x) * 1000) % 256).cast("double")),
    "knn_query": knn_query,
    "knn_pruned": knn_pruned,
    "knn_precomputed": knn_precomputed,
    "ann_recall": ann_recall,
    "forest_recall": forest_recall,
    "forest_query_recall": forest_query_recall,
    "descent_recall": descent_recall,
    "knn_sparse_cosine": _sparse("cosine"),
    "knn_sparse_jaccard": _sparse("jaccard"),
    "graph_normalise": graph_normalise,
    "degree": degree,
    "degree_hist": degree_hist,
    "bipartite_degree": bipartite_degree,
    "bipartite_squares": bipartite_squares,
    "edge_triangles": edge_triangles,
    "codegree": codegree,
    "k3_nodes": _cliques(3),
    "k4_nodes": _cliques(4),
    "k5_nodes": _cliques(5),
    "orbits4_nodes": orbits4_nodes,
    "orbits4_edges": orbits4_edges,
    "orbits4_enumerated": orbits4_enumerated,
    "orbits5_nodes": orbits5_nodes,
    "orbits5_edges": orbits5_edges,
    "graphlet_totals": graphlet_totals,
    "orbit_histogram": orbit_histogram,
    "uniform_max": _affinity(lambda k: A.uniform(k, "max"), K_NEAR),
    "uniform_mean": _affinity(lambda k: A.uniform(k, "mean"), K_NEAR),
    "fixed_sigma": _affinity(lambda k: A.fixed_sigma(k, SIGMA), K_NEAR),
    "perplexity_p": _affinity(lambda k: A.perplexity_based(k, PERPLEXITY, 30)),
    "multiscale_avg": _affinity(lambda k: A.multiscale(k, SCALES)),
    "mixture_p": _affinity(lambda k: A.mixture(k, SCALES)),
    "to_new_p": to_new_p,
    "median_init": median_init,
    "weighted_init": weighted_init,
    "pca_init": pca_init,
    "random_init": random_init,
    "spectral_init": spectral_init,
    "attraction": attraction,
    "repulsion_exact": repulsion_exact,
    "sum_q": sum_q,
    "kl_exact": kl_exact,
    "update_step": update_step,
    "clip_disc": clip_disc,
    "bh_repulsion": bh_repulsion,
    "bh_exact_limit": bh_exact_limit,
    "bh_joined": bh_joined,
    "fft_repulsion": fft_repulsion,
    "tsne_fit": tsne_fit,
    "tsne_transform": tsne_transform,
}

