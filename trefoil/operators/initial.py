"""Starting positions: ``id, y0..``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.operators.gradient import ys
from trefoil.session import cut_lineage, written

SPREAD = 1e-4
# Parts of the affinity table that a walk steps over, and rows of one part once there are more.
WALK_PARTS, WALK_ROWS = 12, 1 << 20


def random(rows: DataFrame, dims: int = 2, seed: int = 0, spread: float = SPREAD) -> DataFrame:
    """Gaussian positions from a hash of the id: the same row gets the same place in any layout of
    the table and in any retry."""
    cols = []
    for c in range(dims):
        u1 = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(2 * c)), F.lit(2 ** 52)) + 1) / F.lit(2.0 ** 52 + 1)
        u2 = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(2 * c + 1)), F.lit(2 ** 52)) / F.lit(2.0 ** 52)
        normal = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * np.pi * u2)
        cols.append((F.lit(spread) * normal).alias(f"y{c}"))
    return rows.select("id", *cols)


def rescale(positions: DataFrame, dims: int, target: float = SPREAD) -> DataFrame:
    """Give the first axis standard deviation ``target``."""
    scale = positions.agg(F.stddev_pop("y0").alias("_sd"))
    return positions.join(F.broadcast(scale)).select(
        "id", *[(F.col(c) / F.col("_sd") * F.lit(target)).alias(c) for c in ys(dims)]
    )


def jitter(positions: DataFrame, dims: int, seed: int = 0, share: float = 0.01) -> DataFrame:
    """Add noise of ``share`` of the first axis' standard deviation, so equal rows separate."""
    noise = random(positions.select("id"), dims, seed, 1.0).toDF("id", *ys(dims, "n"))
    scale = positions.agg(F.stddev_pop("y0").alias("_sd"))
    return positions.join(noise, "id").join(F.broadcast(scale)).select(
        "id", *[(F.col(c) + F.col(f"n{c[1:]}") * F.col("_sd") * F.lit(share)).alias(c) for c in ys(dims)]
    )


def pca(points: DataFrame, dims: int = 2, seed: int = 0, add_jitter: bool = True) -> DataFrame:
    """Leading principal components, scaled down; each component's largest loading is positive."""
    vectors = points.select("id", array_to_vector(F.col("features").cast("array<double>")).alias("x"))
    model = PCA(k=dims, inputCol="x", outputCol="pc").fit(vectors)
    load = model.pc.toArray()
    signs = np.sign(load[np.abs(load).argmax(0), np.arange(dims)])
    parts = vector_to_array("pc")
    raw = model.transform(vectors).select(
        "id", *[(parts[c] * F.lit(float(signs[c]))).alias(f"y{c}") for c in range(dims)]
    )
    means = raw.agg(*[F.avg(c).alias(f"m{c}") for c in ys(dims)])
    centred = raw.join(F.broadcast(means)).select("id", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in ys(dims)])
    small = rescale(centred, dims)
    return jitter(small, dims, seed) if add_jitter else small


def spectral(p: DataFrame, dims: int = 2, seed: int = 0, tolerance: float = 1e-5, steps: int = 12, guard: int = 2,
             max_restarts: int = 200, add_jitter: bool = True) -> DataFrame:
    """Leading non-trivial eigenvectors of the random walk of a symmetric affinity table, times their eigenvalues.

    Block Krylov iteration with thick restarts and the walk W = D^-1 P, which is symmetric in the inner product weighted by
    degree. A cycle extends a block of ``dims + 1 + guard`` vectors by ``steps`` Chebyshev terms of W (one join and grouped
    sum each; the affinities are dealt once, and only a term's own vectors move and are written), brings the terms of a row
    together and sums the Gram matrices of the whole basis in one pass. The next cycle keeps the ``2 * width`` best Ritz
    vectors and extends the block that their residuals span, so close eigenvalues are told apart by the terms of all cycles
    and not of one. It ends when every wanted pair has |W v - value v| <= ``tolerance`` (for |v| = 1), measured by a step of its
    own, and raises if ``max_restarts`` cycles don't reach that. Only Gram matrices, of a size fixed by the parameters, reach
    the driver. Each vector's entry of largest size is positive.
    """
    width = dims + 1 + guard
    edges = cut_lineage(p.groupBy("i", "j").agg(F.sum("p").alias("p")))
    deg = written(edges.groupBy("i").agg(F.sum("p").alias("deg")))
    parts = max(WALK_PARTS, -(-deg.count() // WALK_ROWS))
    # Kept, as a table that is read back has lost how it is dealt; what is lost with an executor comes from the checkpoint.
    edges = edges.repartition(parts, "j").sortWithinPartitions("j").persist()
    edges.count()
    first = _block(width)
    block = deg.join(random(deg.select(F.col("i").alias("id")), width, seed, 1.0).toDF("i", *first), "i").withColumn(first[0], F.lit(1.0))
    kept, head, tail = None, np.zeros((0, 0)), np.zeros((width, 0))
    for _ in range(max_restarts):
        terms = [written(block)]
        for k in range(1, steps + 1):
            rows, scale = _walked(edges, _moving(terms, first), parts, first), 1 if k == 1 else 2
            terms.append(written(rows.selectExpr("i", "deg", *[f"w_{c} * {scale}D / deg AS {c}" for c in first])))
        basis = _basis(terms, first, kept)
        values, mix, off, gram = _ritz(basis, width, steps, head, tail)
        residual = _sizes(off, gram)
        if residual[: dims + 1].max() <= tolerance:
            block = written(_combined(basis, mix[:, :width], first))
            residual = _residuals(edges, block, parts, first, values[:width])
            if residual[: dims + 1].max() <= tolerance:
                break
            kept, head, tail = None, np.zeros((0, 0)), np.zeros((width, 0))  # rounding has added up
            continue
        many = min(2 * width, mix.shape[1])
        fresh, tail = _spanned(off[:, :many], gram, width, tolerance)
        block, head = _combined(basis, fresh, first), np.diag(values[:many])
        kept = _combined(basis, mix[:, :many])
    else:
        raise RuntimeError(f"eigenvectors not found within {tolerance}: residual {residual[: dims + 1].max():.3g} after {max_restarts} restarts")
    block = cut_lineage(block)
    edges.unpersist()
    cols = first[1: dims + 1]
    tops = block.agg(*[F.max_by(F.signum(c), F.struct(F.abs(c), -F.col("i"))).alias(c) for c in cols]).first()
    raw = block.select(F.col("i").alias("id"), *[
        (F.col(c) * F.lit(float(tops[c] * values[e + 1]))).alias(f"y{e}") for e, c in enumerate(cols)
    ])
    out = rescale(raw, dims)
    return jitter(out, dims, seed) if add_jitter else out


def _block(width: int) -> list[str]:
    return [f"t{c}" for c in range(width)]


def _moving(terms: list[DataFrame], cols: list[str]) -> DataFrame:
    """The last term, whose rows move, and the one before it, whose rows stay: taken off half a degree times, so that the sums
    times 2 / deg are the next term. The first step takes nothing off."""
    half, before = ("-0.5D", terms[-2]) if len(terms) > 1 else ("0D", terms[-1])
    return terms[-1].selectExpr("i", "deg", *cols, "true AS moves").unionByName(
        before.selectExpr("i", "deg", *[f"{half} * deg * {c} AS {c}" for c in cols], "false AS moves"))


def _walked(edges: DataFrame, term: DataFrame, parts: int, cols: list[str]) -> DataFrame:
    """``i, deg, w_..``: sums over the neighbours that move and the row's own that stay, in one grouped sum, so that no row is
    joined to its sums. ``edges`` lie in ``parts`` by ``j`` and stay there; the moving rows go to them."""
    last = term.filter("moves").selectExpr("i AS j", *cols).repartition(parts, "j")
    moved = edges.join(last.hint("merge"), "j").selectExpr("i", "0D AS deg", *[f"p * {c} AS {c}" for c in cols])
    both = moved.unionByName(term.filter("NOT moves").select("i", "deg", *cols))
    return both.groupBy("i").agg(F.sum("deg").alias("deg"), *[F.sum(c).alias(f"w_{c}") for c in cols])


def _residuals(edges: DataFrame, block: DataFrame, parts: int, cols: list[str], values: np.ndarray) -> np.ndarray:
    """|W v - value v| of every vector v of the block, by a step of the walk."""
    walk = _walked(edges, _moving([block], cols), parts, cols).drop("deg").join(block, "i")
    gaps = [f"sum(deg * pow(w_{c} / deg - {float(v)!r}D * {c}, 2)) AS {c}" for c, v in zip(cols, values)]
    return np.sqrt(np.array(walk.selectExpr(*gaps).first(), dtype=float))


def _basis(terms: list[DataFrame], cols: list[str], kept: DataFrame | None = None) -> DataFrame:
    """``i, deg, basis``: the vectors kept and the terms of a row, one after the other."""
    rows = None if kept is None else kept.selectExpr("i", "deg", "struct(-1 AS k, basis AS x) AS term")
    for k, term in enumerate(terms):
        some = term.selectExpr("i", "deg", f"struct({k} AS k, array({', '.join(cols)}) AS x) AS term")
        rows = some if rows is None else rows.unionByName(some)
    whole = rows.groupBy("i").agg(F.max("deg").alias("deg"), F.sort_array(F.collect_list("term")).alias("all"))
    return written(whole.select("i", "deg", F.flatten("all.x").alias("basis")))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("basis").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sizes(made: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Lengths of vectors given by their coefficients over the basis."""
    return np.sqrt(np.maximum(np.einsum("ac,ab,bc->c", made, gram, made), 0))


def _ritz(basis: DataFrame, width: int, steps: int, head: np.ndarray,
          tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (descending), their coefficients over the basis and those of W v - value v, and the Gram matrix. W times a kept
    vector is ``head`` of the kept and ``tail`` of block 0; W times a Chebyshev block is the mean of its neighbours (of block 0:
    block 1), so no further product is needed."""
    held = len(head)
    size = held + width * (steps + 1)

    def grams(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                total += x.T @ (x * batch.column("deg").to_numpy()[:, None])
        a, b = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"a": a, "b": b, "s": total[a, b]})

    rows = basis.select("deg", "basis").mapInArrow(grams, "a long, b long, s double")
    got = rows.groupBy("a", "b").agg(F.sum("s").alias("s")).collect()  # size^2 / 2 rows
    gram = np.zeros((size, size))
    for a, b, s in got:
        gram[a, b] = gram[b, a] = s
    m = held + width * steps
    walk = np.zeros((size, m))  # W basis[:, :m] = basis @ walk
    walk[:held, :held], walk[held:held + width, :held] = head, tail
    for k in range(steps):
        for c in range(held, held + width):
            walk[(k + 1) * width + c, k * width + c] = 1.0 if k == 0 else 0.5
            if k:
                walk[(k - 1) * width + c, k * width + c] = 0.5
    # Scaled and whitened; directions that add nothing are left out.
    scale = 1 / np.sqrt(np.maximum(np.diag(gram)[:m], 1e-300))
    spread, axes = np.linalg.eigh(gram[:m, :m] * scale[:, None] * scale[None])
    keep = spread > 1e-12 * spread.max()
    white = scale[:, None] * axes[:, keep] / np.sqrt(spread[keep])
    small = white.T @ (gram[:m] @ walk) @ white
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    values, mix = values[::-1], white @ vectors[:, ::-1]
    padded = np.vstack([mix, np.zeros((size - m, mix.shape[1]))])
    return values, padded, walk @ mix - padded * values, gram


def _spanned(off: np.ndarray, gram: np.ndarray, width: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of ``width`` vectors of length 1 that the residuals ``off`` span, and the residuals' over them. All residuals
    of a cycle lie along its last term, so no more are needed; directions far below the tolerance are left out (zeros)."""
    spread, axes = np.linalg.eigh(off.T @ gram @ off)
    spread, axes = spread[::-1][:width], axes[:, ::-1][:, :width]
    size = np.where(spread > (1e-3 * tolerance) ** 2, np.sqrt(np.maximum(spread, 0)), 0)
    fresh, tail = np.zeros((len(off), width)), np.zeros((width, off.shape[1]))
    fresh[:, : len(size)] = np.divide(off @ axes, size, out=np.zeros((len(off), len(size))), where=size > 0)
    tail[: len(size)] = (axes * size).T
    return fresh, tail


def _combined(basis: DataFrame, mix: np.ndarray, cols: list[str] | None = None) -> DataFrame:
    """``i, deg`` and the basis times ``mix``: a column a vector, or one array ``basis``."""
    def times(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch) @ mix
            made = {c: x[:, n] if n < x.shape[1] else np.zeros(len(x)) for n, c in enumerate(cols or [])} or {
                "basis": pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())}
            yield pa.RecordBatch.from_pydict({"i": batch.column("i"), "deg": batch.column("deg"), **made})

    kinds = ", ".join(f"{c} double" for c in cols) if cols else "basis array<double>"
    return basis.mapInArrow(times, f"i {basis.schema['i'].dataType.simpleString()}, deg double, {kinds}")


def neighbor_median(knn: DataFrame, reference: DataFrame, dims: int, k: int) -> DataFrame:
    """Median reference position of the k nearest references of each new row."""
    rows = knn.filter(F.col("rk") <= k).join(reference.select(F.col("id").alias("j"), *ys(dims)), "j")
    return rows.groupBy(F.col("i").alias("id")).agg(*[F.median(c).alias(c) for c in ys(dims)])


def neighbor_weighted(knn: DataFrame, reference: DataFrame, dims: int, k: int) -> DataFrame:
    """Distance-weighted mean of reference positions (farther references weigh more, as the
    original operator defines it)."""
    rows = knn.filter(F.col("rk") <= k).join(reference.select(F.col("id").alias("j"), *ys(dims)), "j")
    return rows.groupBy(F.col("i").alias("id")).agg(
        *[(F.sum(F.col("d") * F.col(c)) / F.sum("d")).alias(c) for c in ys(dims)]
    )
