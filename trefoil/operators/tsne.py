"""The map-layout estimator: fit a map, optimise it further, place new rows into it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.functions import layout as L
from trefoil.operators import affinity as A
from trefoil.operators import gradient as G
from trefoil.operators import initial as I
from trefoil.operators import neighbors as N
from trefoil.operators import convolve, placing
from trefoil.operators.cells import CellTree
from trefoil.operators.forest import Forest
from trefoil.session import cut_lineage

AFFINITIES = ("perplexity", "mixture", "multiscale", "fixed_sigma", "uniform")


@dataclass
class Affinities:
    """An affinity table with what is needed to connect new rows to it."""

    p: DataFrame
    kind: str = "precomputed"
    points: DataFrame | None = None
    knn: DataFrame | None = None
    k: int = 0
    n: int = 0
    perplexities: list[float] = field(default_factory=list)
    sigma: float | None = None
    metric: str | Callable = "euclidean"
    params: dict | None = None
    symmetrize: bool | str = True
    method: str = "auto"
    seed: int = 0
    #: The stored index that new rows ask, and the number of neighbours it was made for.
    index: Forest | None = None
    index_k: int = 0

    @property
    def perplexity(self) -> float:
        if self.kind not in ("perplexity", "mixture") or len(self.perplexities) != 1:
            raise TypeError("only single-perplexity affinities have one perplexity")
        return self.perplexities[0]

    @staticmethod
    def build(points: DataFrame | None, kind: str = "perplexity", perplexity: float | list[float] = 30,
              sigma: float | None = None, k: int | None = None, method: str = "auto",
              metric: str | Callable = "euclidean", params: dict | None = None,
              symmetrize: bool | str = True, seed: int = 0, neighbours: DataFrame | None = None,
              index: Forest | None = None) -> "Affinities":
        """Neighbours by the chosen method, then the chosen kernel. A table ``neighbours`` (i, j, d) or a stored ``index``
        takes the place of the search; with a table alone (no points) new rows can't be placed."""
        if kind not in AFFINITIES:
            raise ValueError(f"unknown affinity kind {kind!r}")
        if neighbours is not None and index is not None:
            raise ValueError("give a neighbour table or an index, not both")
        given = None
        if neighbours is not None:
            given = cut_lineage(N._merge(neighbours.filter(F.col("i") != F.col("j")).select("i", "j", "d"), 1 << 30))
            sizes = given.groupBy("i").count().agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("k")).first()
            n, most = sizes["n"], sizes["k"]
        elif index is not None:
            n = index.n
        else:
            n = points.select("i" if metric == "precomputed" else "id").distinct().count()
        scales = [float(x) for x in (perplexity if isinstance(perplexity, (list, tuple)) else [perplexity])]
        if kind in ("mixture", "multiscale"):
            scales = A.check_perplexities(scales, n)
        if kind in ("fixed_sigma", "uniform"):
            k = k or 30
            if k >= n:
                raise ValueError(f"k={k} does not fit {n} rows")
        else:
            k = A.n_neighbors(n, max(scales))
        if given is not None:
            if k > most:
                raise ValueError(f"{k} neighbours are needed, but some rows of the table have {most}")
            knn = given.filter(F.col("rk") <= k)
        elif index is not None:
            knn = cut_lineage(index.own(k))
        else:
            knn = cut_lineage(N.nearest(points, k, method, metric, params, seed))
        made = Affinities(knn, kind, points, knn, k, n, scales, sigma, metric, params, symmetrize, method, seed, index,
                          k if index is not None else 0)
        made.p = cut_lineage(made._kernel(symmetrize))
        return made

    def nearest_to_new(self, points: DataFrame, k: int) -> DataFrame:
        """The reference rows nearest to new rows: by the exact join if the reference used it, else by the stored
        index, which is made when it is first asked and remade only for more neighbours."""
        if self.points is None and self.index is None:
            raise TypeError("precomputed affinities cannot be extended to new rows")
        if self.method == "exact" and self.index is None:
            return N.query_knn(self.points, points, k, self.metric, self.params)
        if self.index is None or (self.index_k < k and self.points is not None):
            self.index, self.index_k = Forest.build(self.points, self.metric, self.params, k=k, seed=self.seed), k
        return self.index.query(points, k)

    def _kernel(self, symmetrize: bool | str) -> DataFrame:
        if self.kind == "perplexity":
            return A.perplexity_based(self.knn, self.perplexities[0], self.k, bool(symmetrize))
        if self.kind == "mixture":
            return A.mixture(self.knn, self.perplexities, bool(symmetrize))
        if self.kind == "multiscale":
            return A.multiscale(self.knn, self.perplexities, bool(symmetrize))
        if self.kind == "fixed_sigma":
            return A.fixed_sigma(self.knn, self.sigma, bool(symmetrize))
        return A.uniform(self.knn, "max" if symmetrize is True else symmetrize)

    def set_perplexities(self, perplexities: list[float]) -> "Affinities":
        """Recompute a mixture or an average for other scales from the neighbours at hand."""
        if self.kind not in ("mixture", "multiscale"):
            raise TypeError("only affinities of several scales have perplexities")
        scales = A.check_perplexities([float(x) for x in perplexities], self.n)
        if scales == self.perplexities:
            return self
        kept = A.limit_neighbors(self.knn, scales[-1], self.k)
        made = Affinities(kept, self.kind, self.points, kept, min(self.k, int(3 * scales[-1])), self.n, scales,
                          self.sigma, self.metric, self.params, self.symmetrize,
                          self.method, self.seed, self.index, self.index_k)
        made.p = cut_lineage(made._kernel(self.symmetrize))
        return made

    def set_perplexity(self, perplexity: float) -> "Affinities":
        """Recompute for a smaller perplexity from the neighbours at hand."""
        if self.kind in ("mixture", "multiscale"):
            return self.set_perplexities([perplexity])
        if self.kind == "perplexity" and perplexity == self.perplexities[0]:
            return self
        kept = A.limit_neighbors(self.knn, perplexity, self.k)
        k = min(self.k, int(3 * perplexity))
        made = Affinities(kept, self.kind, self.points, kept, k, self.n, [float(perplexity)], self.sigma,
                          self.metric, self.params, self.symmetrize,
                          self.method, self.seed, self.index, self.index_k)
        made.p = cut_lineage(made._kernel(self.symmetrize))
        return made

    def to_new(self, points: DataFrame, perplexity: float | list[float] | None = None, k: int | None = None,
               sigma: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(row-normalised affinities to the reference rows, neighbour table). ``k`` neighbours a row and ``sigma``
        replace those of the reference; scales above a third of the reference rows are capped in mixtures."""
        if self.points is None and self.index is None:
            raise TypeError("precomputed affinities cannot be extended to new rows")
        scales = self.perplexities if perplexity is None else perplexity
        scales = [float(x) for x in (scales if isinstance(scales, (list, tuple)) else [scales])]
        if self.kind in ("mixture", "multiscale"):
            scales = A.check_perplexities(scales, self.n)
        if k is None:
            k = self.k if self.kind in ("fixed_sigma", "uniform") else min(self.n, int(3 * max(scales)))
        elif k > self.n:
            raise ValueError(f"k={k} does not fit {self.n} rows")
        knn = cut_lineage(self.nearest_to_new(points, k))
        if self.kind == "fixed_sigma":
            return A.to_new_fixed_sigma(knn, self.sigma if sigma is None else sigma), knn
        if self.kind == "uniform":
            return A.to_new_uniform(knn), knn
        if self.kind == "multiscale":
            return A.to_new_multiscale(knn, scales), knn
        if self.kind == "perplexity":
            scales = [A.effective_perplexity(scales[0], k)]
        return A.to_new(knn, scales), knn


@dataclass
class TSNE:
    n_components: int = 2
    perplexity: float | list[float] = 30
    learning_rate: float | str = "auto"
    early_exaggeration_iter: int = 250
    early_exaggeration: float | str = "auto"
    n_iter: int = 500
    exaggeration: float | None = None
    dof: float = 1.0
    theta: float = 0.5
    n_interpolation_points: int = 3
    min_num_intervals: int = 50
    ints_in_interval: float = 1.0
    initialization: str | DataFrame = "pca"
    metric: str | Callable = "euclidean"
    metric_params: dict | None = None
    initial_momentum: float = 0.8
    final_momentum: float = 0.8
    max_grad_norm: float | None = None
    max_step_norm: float | None = 5.0
    neighbors: str = "auto"
    negative_gradient_method: str | Callable = "auto"
    callbacks: list = field(default_factory=list)
    callbacks_every_iters: int = 50
    random_state: int = 0

    def settings(self) -> G.Settings:
        return G.Settings(
            learning_rate=self.learning_rate, dof=self.dof, theta=self.theta,
            method=self.negative_gradient_method, points=self.n_interpolation_points,
            min_boxes=self.min_num_intervals, per_box=self.ints_in_interval,
            max_grad_norm=self.max_grad_norm, max_step_norm=self.max_step_norm,
            callbacks=list(self.callbacks), callbacks_every=self.callbacks_every_iters,
        )

    def prepare_initial(self, points: DataFrame | None = None, affinities: Affinities | None = None,
                        initialization: DataFrame | None = None) -> "TSNEEmbedding":
        if affinities is None:
            affinities = Affinities.build(
                points, "mixture", self.perplexity, method=self.neighbors, metric=self.metric, params=self.metric_params,
                seed=self.random_state,
            )
        start = initialization if initialization is not None else self.initialization
        named = isinstance(start, str)
        if named and start == "pca" and (points is None or self.metric == "precomputed"):
            start = "spectral"
        ids = affinities.p.select(F.col("i").alias("id")).distinct()
        if not named:
            positions = start
        elif start == "pca":
            positions = I.pca(points, self.n_components, self.random_state)
        elif start == "random":
            positions = I.random(ids, self.n_components, self.random_state)
        elif start == "spectral":
            positions = I.spectral(affinities.p, self.n_components, self.random_state)
        else:
            raise ValueError(f"unknown initialization {start!r}")
        state = cut_lineage(G.start_layout(positions, self.n_components))
        n = state.count()
        spread = affinities.p.repartition("i")
        return TSNEEmbedding(state, affinities, self, n, cut_lineage(spread))

    def fit(self, points: DataFrame | None = None, affinities: Affinities | None = None,
            initialization: DataFrame | None = None) -> "TSNEEmbedding":
        """Early exaggeration, then the normal phase. A callback that stops either phase returns the
        layout so far."""
        emb = self.prepare_initial(points, affinities, initialization)
        strong = self.early_exaggeration
        if strong == "auto":
            strong = max(12, self.exaggeration or 12)
        try:
            emb.optimize(self.early_exaggeration_iter, exaggeration=strong, momentum=self.initial_momentum,
                         inplace=True, propagate=True)
            emb.optimize(self.n_iter, exaggeration=self.exaggeration, momentum=self.final_momentum,
                         inplace=True, propagate=True)
        except G.OptimizationInterrupt as stop:
            emb.layout, emb.kl_divergence = stop.final_embedding, stop.error
        return emb


@dataclass
class TSNEEmbedding:
    """A map in Spark: ``layout`` holds positions and optimiser state, ``positions`` only places."""

    layout: DataFrame
    affinities: Affinities
    model: TSNE
    n: int
    p: DataFrame
    kl_divergence: float | None = None

    @property
    def dims(self) -> int:
        return self.model.n_components

    @property
    def positions(self) -> DataFrame:
        return self.layout.select("id", *G.ys(self.dims))

    def optimize(self, n_iter: int, exaggeration: float | None = None, momentum: float = 0.8,
                 inplace: bool = False, propagate: bool = False, **changes) -> "TSNEEmbedding":
        target = self if inplace else TSNEEmbedding(
            self.layout, self.affinities, self.model, self.n, self.p, self.kl_divergence
        )
        s = self.model.settings().with_(exaggeration=exaggeration, momentum=momentum, **changes)
        try:
            target.layout = G.descend(target.layout, target.p, self.dims, self.n, n_iter, s)
            target.kl_divergence = G.final_divergence(target.layout, target.p, self.dims, self.n, s)
        except G.OptimizationInterrupt as stop:
            if propagate:
                raise
            target.layout, target.kl_divergence = stop.final_embedding, stop.error
        return target

    def pbic(self) -> float:
        """2*KL + ln(n)*perplexity/n; only for single-perplexity affinities."""
        return 2 * self.kl_divergence + np.log(self.n) * self.affinities.perplexity / self.n

    def prepare_partial(self, points: DataFrame, initialization: str | DataFrame = "median", k: int = 25,
                        perplexity: float | list[float] | None = None) -> "PartialTSNEEmbedding":
        p, knn = self.affinities.to_new(points, perplexity)
        frame, ends = self._centred()
        if isinstance(initialization, DataFrame):
            start = initialization
        elif initialization == "median":
            start = I.neighbor_median(knn, frame, self.dims, k)
        elif initialization == "weighted":
            start = I.neighbor_weighted(knn, frame, self.dims, k)
        elif initialization == "random":
            start = I.random(points.select("id"), self.dims, self.model.random_state)
        else:
            raise ValueError(f"unknown initialization {initialization!r}")
        places = frame.select(F.col("id").alias("j"), F.array(*G.ys(self.dims)).alias("at"))
        linked = p.join(places, "j").groupBy(F.col("i").alias("id")).agg(
            F.sort_array(F.collect_list(F.struct("j", "p", "at"))).alias("links")  # k links per row
        ).select("id", F.col("links.p").alias("weights"), F.flatten("links.at").alias("places"))
        state = cut_lineage(G.start_layout(start, self.dims).join(linked, "id"))
        return PartialTSNEEmbedding(state, self, frame, ends, p)

    def _centred(self) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
        """Reference positions around the middle of their range, on a copy."""
        _, low, high = G.moments(self.layout, self.dims)
        mid = (low + high) / 2
        frame = G.shifted(self.positions, self.dims, mid)
        return frame, (low - mid, high - mid)

    def transform(self, points: DataFrame, perplexity: float | list[float] = 5,
                  initialization: str | DataFrame = "median", k: int = 25, learning_rate: float = 0.1,
                  early_exaggeration: float = 4, early_exaggeration_iter: int = 0,
                  exaggeration: float = 1.5, n_iter: int = 250, initial_momentum: float = 0.8,
                  final_momentum: float = 0.8, max_grad_norm: float | None = 0.25,
                  max_step_norm: float | None = None, method: str = "auto") -> "PartialTSNEEmbedding":
        """Place new rows into the map; rows do not influence each other or the map."""
        part = self.prepare_partial(points, initialization, k, perplexity)
        part = part.optimize(early_exaggeration_iter, learning_rate, early_exaggeration, initial_momentum,
                             max_grad_norm, max_step_norm, method)
        return part.optimize(n_iter, learning_rate, exaggeration, final_momentum, max_grad_norm,
                             max_step_norm, method)


@dataclass
class PartialTSNEEmbedding:
    """New rows against a frozen map; regions of the map do all iterations of their rows at once."""

    layout: DataFrame
    parent: TSNEEmbedding
    reference: DataFrame
    ends: tuple[np.ndarray, np.ndarray]
    p: DataFrame
    kl_divergence: float | None = None

    @property
    def positions(self) -> DataFrame:
        return self.layout.select("id", *G.ys(self.parent.dims))

    def optimize(self, n_iter: int, learning_rate: float = 0.1, exaggeration: float | None = 1.5,
                 momentum: float = 0.8, max_grad_norm: float | None = 0.25,
                 max_step_norm: float | None = None, method: str = "auto",
                 freeze_inner_gains: bool = True, padding: float = 0.25, callbacks: list | None = None,
                 callbacks_every: int = 50, propagate: bool = False) -> "PartialTSNEEmbedding":
        """``n_iter`` steps of every row. Callbacks are asked at their turns with the divergence of the new rows; one that
        stops the run leaves the rows where they are then."""
        if n_iter == 0:
            return self
        model, dims = self.parent.model, self.parent.dims
        source, limit = self._field(method, padding)
        watch = G.Watch(list(callbacks or []), callbacks_every)
        step = lambda n: L.NewRows(learning_rate, exaggeration or 1.0, momentum, 0.01, max_grad_norm, max_step_norm,
                                   n, model.dof, limit, freeze_inner_gains)
        now, done = self, 0
        while done < n_iter:
            many = min(callbacks_every - done % callbacks_every, n_iter - done) if watch.callbacks else n_iter
            moved = cut_lineage(placing.place(now.layout, source, step(many)))
            done += many
            now = PartialTSNEEmbedding(moved.drop("z"), self.parent, self.reference, self.ends, self.p)
            z = float(moved.agg(F.sum("z")).first()[0] or 0.0)
            now.kl_divergence = G.divergence(self.p, now.positions, self.reference, dims, z, model.dof, small=False)
            if watch.due(done):
                try:
                    watch.ask(done, now.kl_divergence, now.positions)
                except G.OptimizationInterrupt:
                    if propagate:
                        raise
                    return now
        return now

    def _field(self, method: str, padding: float) -> tuple[placing.GridField | placing.TreeField, tuple[float, float] | None]:
        """Where repulsion comes from: unless another is named, by the method that made the map; an exact sum is a
        tree with every cell opened."""
        parent, model, dims = self.parent, self.parent.model, self.parent.dims
        method = G.resolve_method(model.negative_gradient_method if method == "auto" else method, dims)
        if callable(method):
            raise ValueError("name a gradient method for new rows: a function of whole layouts can't place them")
        if method != "fft":
            tree = CellTree.build(self.reference, dims)
            return placing.TreeField(tree, model.theta if method == "bh" else 0.0, model.dof), None
        low, high = self.ends
        reach = max(abs(low.min()), abs(high.max())) * (1 + padding)
        grid = L.make_grid([-reach] * dims, [reach] * dims, model.n_interpolation_points, model.min_num_intervals,
                           model.ints_in_interval)
        boxes = cut_lineage(convolve.potentials(self.reference, dims, grid, model.dof))
        return placing.GridField(grid, boxes, dims), (-reach, reach)


class TSNETransformer:
    """``fit`` / ``fit_transform`` / ``transform`` over tables ``id, features``; the last two return
    plain positions ``id, y0..``."""

    def __init__(self, **options):
        self.model, self.embedding = TSNE(**options), None

    def fit(self, points: DataFrame) -> "TSNETransformer":
        self.embedding = self.model.fit(points)
        return self

    def fit_transform(self, points: DataFrame) -> DataFrame:
        return self.fit(points).embedding.positions

    def transform(self, points: DataFrame, **options) -> DataFrame:
        if self.embedding is None:
            raise ValueError("fit before transform")
        return self.embedding.transform(points, **options).positions


class VerifyExaggerationError:
    """Callback: the loop's error must equal the divergence computed with plain affinities."""

    def __init__(self, embedding: TSNEEmbedding, tolerance: float = 1e-8):
        self.embedding, self.tolerance = embedding, tolerance

    def __call__(self, iteration: int, error: float, layout: DataFrame) -> bool:
        emb = self.embedding
        true = G.final_divergence(layout, emb.p, emb.dims, emb.n, emb.model.settings())
        if abs(true - error) > self.tolerance:
            raise RuntimeError(f"error {error} differs from the unexaggerated divergence {true}")
        return False


class ErrorApproximations:
    """Callback: differences of tree and grid divergences from the exact one; see ``report``."""

    def __init__(self, embedding: TSNEEmbedding):
        self.embedding = embedding
        self.rows: list[tuple[float, float]] = []

    def __call__(self, iteration: int, error: float, layout: DataFrame) -> bool:
        emb, s = self.embedding, self.embedding.model.settings()
        exact, tree, grid = (
            G.final_divergence(layout, emb.p, emb.dims, emb.n, s.with_(method=m)) for m in ("exact", "bh", "fft")
        )
        self.rows.append((tree - exact, grid - exact))
        return False

    def report(self) -> dict[str, float]:
        got = np.array(self.rows)
        return {
            "bh_mean": got[:, 0].mean(), "bh_std": got[:, 0].std(),
            "fft_mean": got[:, 1].mean(), "fft_std": got[:, 1].std(),
        }


def kl_divergence(positions: DataFrame, p: DataFrame, dims: int, method: str = "exact", theta: float = 0.5,
                  dof: float = 1.0, min_num_intervals: int = 10) -> float:
    """Divergence of affinities against fixed positions: exact, by tree, or by grid."""
    s = G.Settings(method=method, theta=theta, dof=dof, min_boxes=min_num_intervals)
    layout = G.start_layout(positions, dims)
    return G.final_divergence(layout, p, dims, layout.count(), s)
