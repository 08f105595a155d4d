"""Independent DuckDB SQL for the registered queries: same names, columns and rounding."""

from __future__ import annotations

from trefoil.functions import patterns
from trefoil.plans import layout_sql
from trefoil.plans import registry as Q

EXPR = """
sold AS (SELECT c_nationkey AS nk, l_partkey AS pk, sum(l_quantity) AS v
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         GROUP BY 1, 2),
expr AS (SELECT n_nationkey AS sample, p_partkey AS row_idx, p_brand, p_type,
                coalesce(v, 0.0) AS value
         FROM nation CROSS JOIN part LEFT JOIN sold ON nk = n_nationkey AND pk = p_partkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, row_idx) AS q,
                  rank() OVER (PARTITION BY sample ORDER BY value)
                  + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS r,
                  count(*) OVER (PARTITION BY sample) AS n
           FROM expr)
"""


def _scores(weight: str = "power(r, 0.25)", member: str = "p_brand", where: str = "true", having: str = "true") -> str:
    return f"""{EXPR},
weighted AS (SELECT *, {weight} AS w FROM ranked),
scores AS (SELECT sample, {member} AS set_name,
                  sum(w * q) / sum(w) - (max(n) * (max(n) + 1) / 2.0 - sum(q)) / (max(n) - count(*)) AS score
           FROM weighted WHERE {where} GROUP BY 1, 2 HAVING {having})
"""


def _plain(**kw) -> str:
    return f"WITH {_scores(**kw)} SELECT sample, set_name, round(score, 6) AS score FROM scores"


WALK = f"""WITH {EXPR},
walk AS (SELECT s.set_name, e.sample, e.q, e.n,
                CASE WHEN e.p_brand = s.set_name THEN power(e.r, 0.25) ELSE 0 END AS w,
                CASE WHEN e.p_brand = s.set_name THEN 1 ELSE 0 END AS m
         FROM ranked e CROSS JOIN (SELECT DISTINCT p_brand AS set_name FROM part) s),
cdf AS (SELECT set_name, sample,
               sum(w) OVER o / sum(w) OVER g - sum(1 - m) OVER o / sum(1 - m) OVER g AS diff
        FROM walk
        WINDOW o AS (PARTITION BY set_name, sample ORDER BY q DESC ROWS UNBOUNDED PRECEDING),
               g AS (PARTITION BY set_name, sample))
SELECT sample, set_name, round(sum(diff), 6) AS score FROM cdf GROUP BY 1, 2"""

PTS = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings)"

DIST = {
    "euclidean": "list_distance(a.f, b.f)",
    "cosine": "list_cosine_distance(a.f, b.f)",
    "manhattan": "list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))",
    "canberra": "list_sum(list_transform(list_zip(a.f, b.f), lambda z: CASE WHEN z[1] = 0 AND z[2] = 0 "
                "THEN 0 ELSE abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) END))",
}


#: Metrics on rows made otherwise: the rows, and the distance between them.
MADE = {
    "spearmanr": (
        "list_transform(f, lambda x: len(list_filter(f, lambda y: y < x)) + (len(list_filter(f, lambda y: y = x)) + 1) / 2.0 - (len(f) + 1) / 2.0)",
        DIST["cosine"]),
    "wasserstein_1d": (
        "list_transform(range(1, len(f) + 1), lambda i: list_sum(list_transform(f[1:i], lambda x: abs(x))) / list_sum(list_transform(f, lambda x: abs(x))))",
        DIST["manhattan"]),
    "jensen_shannon": (
        "list_transform(f, lambda x: (abs(x) + power(2, -23)) / list_sum(list_transform(f, lambda y: abs(y) + power(2, -23))))",
        "list_sum(list_transform(list_zip(a.f, b.f), lambda z: 0.5 * (z[1] * ln(2 * z[1] / (z[1] + z[2])) + z[2] * ln(2 * z[2] / (z[1] + z[2])))))"),
    "bit_hamming": (
        "list_transform(f, lambda x: CAST(floor(abs(x) * 1000) AS BIGINT) % 256)",
        "list_sum(list_transform(list_zip(a.f, b.f), lambda z: bit_count(xor(z[1], z[2]))))::DOUBLE"),
}


def _knn(k: int, metric: str = "euclidean", pair: str = "a.id <> b.id") -> str:
    rows, dist = (PTS, DIST[metric]) if metric in DIST else (
        f"{PTS.replace('pts AS', 'raw AS', 1)}, pts AS (SELECT id, {MADE[metric][0]} AS f, label FROM raw)", MADE[metric][1])
    return f"""{rows},
knn AS (SELECT * FROM (
    SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk
    FROM (SELECT a.id AS i, b.id AS j, {dist} AS d FROM pts a, pts b WHERE {pair}))
  WHERE rk <= {k})"""


SPLIT = "a.label < 2 AND b.label >= 2"
# All pairs of customers, whether they share a part or not.
BASKETS = """cells AS (SELECT o_custkey AS id, l_partkey AS dim, sum(l_quantity)::DOUBLE AS w FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
sizes AS (SELECT c_custkey AS id, coalesce(sum(w * w), 0) AS norm, count(w) AS n FROM customer LEFT JOIN cells ON id = c_custkey GROUP BY 1),
common AS (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS dot, count(*) AS n FROM cells a JOIN cells b USING (dim)
    WHERE a.id <> b.id GROUP BY 1, 2),
pairs AS (SELECT a.id AS i, b.id AS j, coalesce(c.dot / (sqrt(a.norm) * sqrt(b.norm)), 0) AS cosine,
    coalesce(c.n / (a.n + b.n - c.n), 0) AS jaccard
    FROM sizes a JOIN sizes b ON a.id <> b.id LEFT JOIN common c ON c.i = a.id AND c.j = b.id)"""


def _sparse(metric: str) -> str:
    return f"""WITH {BASKETS}, knn AS (SELECT i, j, 1 - {metric} AS d, row_number() OVER (PARTITION BY i ORDER BY 1 - {metric}, j) AS rk
        FROM pairs QUALIFY rk <= {Q.K_NEAR}) {KNN_OUT}"""


KNN_OUT = "SELECT i, j, round(d, 6) AS d, rk::INTEGER AS rk FROM knn"

GRAPH = f"""{_knn(Q.K_GRAPH)},
edges AS (SELECT DISTINCT least(i, j) AS x, greatest(i, j) AS y FROM knn),
adj AS (SELECT x AS s, y AS d FROM edges UNION ALL SELECT y, x FROM edges)"""

BIP = """edges AS (SELECT DISTINCT least(l_suppkey * 2, l_partkey * 2 + 1) AS x,
                          greatest(l_suppkey * 2, l_partkey * 2 + 1) AS y FROM lineitem),
adj AS (SELECT x AS s, y AS d FROM edges UNION ALL SELECT y, x FROM edges)"""


def _cliques(size: int) -> str:
    names = "abcde"[:size]
    joins, conds = [], []
    for n, c in enumerate(names[1:], 1):
        joins.append(f"JOIN edges e0{n} ON e0{n}.x = v0.v")
        conds += [f"e{m}{n}.x = e0{m}.y AND e{m}{n}.y = e0{n}.y" for m in range(1, n)]
    more = [f"JOIN edges e{m}{n} ON {c}" for (m, n), c in zip(
        [(m, n) for n in range(2, size) for m in range(1, n)], conds)]
    cols = ", ".join(["v0.v"] + [f"e0{n}.y" for n in range(1, size)])
    order = " AND ".join(f"e0{n}.y < e0{n + 1}.y" for n in range(1, size - 1)) or "true"
    return f"""WITH {GRAPH},
v0 AS (SELECT id AS v FROM pts),
found AS (SELECT unnest([{cols}]) AS v FROM v0 {' '.join(joins)} {' '.join(more)} WHERE {order})
SELECT p.id AS v, count(found.v) AS n_cliques FROM pts p LEFT JOIN found ON found.v = p.id GROUP BY 1"""


def _signature(edges, k: int, root: int) -> str:
    nbrs = patterns.adjacency(edges, k)
    deg = [len(x) for x in nbrs]
    text = lambda xs: "[" + ", ".join(map(str, sorted(xs))) + "]"
    closed = sum(1 for x in nbrs[root] for y in nbrs[root] if x < y and y in nbrs[x])
    return f"{deg[root]}|{text(deg[x] for x in nbrs[root])}|{text(deg)}|{closed}"


def _orbit_base(size: int) -> str:
    """Enumerate connected induced subgraphs as sorted id lists and name each member's orbit by its
    inner degree, its neighbours' inner degrees, all inner degrees and its triangles."""
    rows, seen = [], {}
    for g, (text, orbits) in patterns.GRAPHLETS.items():
        if not 3 <= len(orbits) <= size:
            continue
        edges = patterns.parse(text)
        for node, o in enumerate(orbits):
            sig = _signature(edges, len(orbits), node)
            if seen.setdefault(sig, o) != o:
                raise AssertionError("orbit signature is not unique")
    rows = ", ".join(f"('{s}', {o})" for s, o in seen.items())
    grow = "".join(
        f""",
s{k} AS (SELECT DISTINCT list_sort(list_append(m, d)) AS m
         FROM (SELECT m, unnest(m) AS u FROM s{k - 1}) JOIN adj ON s = u WHERE NOT list_contains(m, d))"""
        for k in range(3, size + 1)
    )
    every = " UNION ALL ".join(f"SELECT m FROM s{k}" for k in range(3, size + 1))
    return f"""{GRAPH},
s2 AS (SELECT [x, y] AS m FROM edges){grow},
sets AS (SELECT row_number() OVER () AS sid, m FROM ({every})),
members AS (SELECT sid, unnest(m) AS v FROM sets),
links AS (SELECT a.sid, a.v, b.v AS w FROM members a JOIN adj ON s = a.v JOIN members b ON b.sid = a.sid AND b.v = d),
inner_deg AS (SELECT sid, v, count(*) AS k FROM links GROUP BY 1, 2),
whole AS (SELECT sid, list_sort(list(k)) AS ks FROM inner_deg GROUP BY 1),
around AS (SELECT l.sid, l.v, list_sort(list(i.k)) AS nk FROM links l JOIN inner_deg i ON i.sid = l.sid AND i.v = l.w
           GROUP BY 1, 2),
closed AS (SELECT a.sid, a.v, count(*) AS t FROM links a JOIN links b ON b.sid = a.sid AND b.v = a.v AND a.w < b.w
           JOIN links c ON c.sid = a.sid AND c.v = a.w AND c.w = b.w GROUP BY 1, 2),
names(sig, orbit) AS (VALUES {rows}),
placed AS (SELECT i.sid, i.v, n.orbit
           FROM inner_deg i JOIN around a USING (sid, v) JOIN whole w USING (sid) LEFT JOIN closed t USING (sid, v)
           JOIN names n ON n.sig = concat(i.k::VARCHAR, '|', a.nk::VARCHAR, '|', w.ks::VARCHAR, '|',
                                          coalesce(t.t, 0)::VARCHAR)),
degs AS (SELECT p.id AS v, count(s) AS deg FROM pts p LEFT JOIN adj ON s = p.id GROUP BY 1)"""


def _node_orbits(size: int) -> str:
    n = patterns.N_NODE_ORBITS[size]
    cols = ", ".join(f"count(*) FILTER (WHERE orbit = {o}) AS o{o}" for o in range(1, n))
    return f"""{_orbit_base(size)},
wide AS (SELECT v, any_value(deg) AS o0, {cols} FROM degs LEFT JOIN placed USING (v) GROUP BY v)"""


def _edge_orbits(size: int) -> str:
    pairs = []
    for o, (g, a, b) in patterns.edge_orbits().items():
        orbits = patterns.GRAPHLETS[g][1]
        if o >= 0 and len(orbits) <= size:
            pairs.append(f"({min(orbits[a], orbits[b])}, {max(orbits[a], orbits[b])}, {o})")
    cols = ", ".join(
        f"count(*) FILTER (WHERE eo = {o}) AS e{o}" for o in range(patterns.N_EDGE_ORBITS[size])
    )
    return f"""WITH {_orbit_base(size)},
kinds(lo, hi, eo) AS (VALUES {', '.join(pairs)}),
seen AS (SELECT l.v AS src, l.w AS dst, k.eo
         FROM links l JOIN placed a ON a.sid = l.sid AND a.v = l.v JOIN placed b ON b.sid = l.sid AND b.v = l.w
         JOIN kinds k ON k.lo = least(a.orbit, b.orbit) AND k.hi = greatest(a.orbit, b.orbit)
         WHERE l.v < l.w)
SELECT e.x AS src, e.y AS dst, {cols}
FROM edges e LEFT JOIN seen ON seen.src = e.x AND seen.dst = e.y GROUP BY 1, 2"""


def _calibrated(name: str, perplexity: float, start: str, source: str) -> str:
    kernel = "list_sum(list_transform(ds, lambda d: sqrt(tau) * exp(-d * d * tau * 0.5)))"
    spread = "list_sum(list_transform(ds, lambda d: sqrt(tau) * exp(-d * d * tau * 0.5) * d * d))"
    eps = "2.220446049250313e-16"
    return f"""
{name} AS (
  SELECT i, ds, 1.0::DOUBLE AS tau, {start}, 0 AS step, false AS done FROM {source}
  UNION ALL
  SELECT i, ds,
         CASE WHEN abs(g) <= 1e-8 THEN tau
              WHEN g > 0 THEN CASE WHEN hi IS NULL THEN tau * 2 ELSE (tau + hi) / 2 END
              ELSE CASE WHEN lo IS NULL THEN tau / 2 ELSE (tau + lo) / 2 END END,
         CASE WHEN abs(g) > 1e-8 AND g > 0 THEN tau ELSE lo END,
         CASE WHEN abs(g) > 1e-8 AND NOT g > 0 THEN tau ELSE hi END,
         step + 1, abs(g) <= 1e-8
  FROM (SELECT *, tau * 0.5 * {spread} / ({kernel} + {eps}) + ln({kernel} + {eps}) - ln(tau) * 0.5
                  - ln({perplexity}) AS g
        FROM {name} WHERE NOT done AND step < 200)),
{name}_end AS (SELECT i, ds, tau, lo, hi FROM {name} WHERE done)"""


LISTS = "nn AS (SELECT i, list(d ORDER BY d, j) AS ds FROM knn GROUP BY i)"
FRESH = "NULL::DOUBLE AS lo, NULL::DOUBLE AS hi"


def _kernel_rows(name: str, ends: list[str]) -> str:
    """Row-normalised (mixed) kernels from one or more calibrated scales."""
    parts = " UNION ALL ".join(
        f"SELECT k.i, k.j, sqrt(c.tau) * exp(-k.d * k.d * c.tau * 0.5) AS w FROM knn k JOIN {e} c USING (i)" for e in ends
    )
    return f"""
{name}_raw AS (SELECT i, j, sum(w) AS w FROM ({parts}) GROUP BY 1, 2),
{name} AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS p FROM {name}_raw)"""


def _sym(name: str, source: str) -> str:
    return f"""
{name}_s AS (SELECT i, j, sum(p) / 2 AS p FROM (SELECT i, j, p FROM {source} UNION ALL SELECT j, i, p FROM {source})
             GROUP BY 1, 2),
{name} AS (SELECT i, j, p / sum(p) OVER () AS p FROM {name}_s)"""


P_OUT = "SELECT i, j, round(p, 9) AS p FROM p"
UNIFORM_MEAN = f"{_knn(Q.K_NEAR)}, ones AS (SELECT i, j, 1.0 AS p FROM knn), {_sym('p', 'ones')}"

POS = f"pos AS (SELECT vec_id AS id, embedding[1]::DOUBLE * {Q.STRETCH} AS y0, embedding[2]::DOUBLE * {Q.STRETCH} AS y1 FROM embeddings)"


def _pairs(dof: float = 1.0) -> str:
    return f"""{POS},
pairs AS (SELECT a.id AS i, b.id AS j, a.y0 - b.y0 AS e0, a.y1 - b.y1 AS e1,
                 1.0 / (1.0 + ((a.y0 - b.y0) ** 2 + (a.y1 - b.y1) ** 2) / {dof}) AS base
          FROM pos a, pos b WHERE a.id <> b.id)"""


FORCES = "forces AS (SELECT i, sum(base) AS z, sum(base * base * e0) AS f0, sum(base * base * e1) AS f1 FROM pairs GROUP BY i)"
PULL = """pull AS (SELECT i, sum(p * base * e0) AS at0, sum(p * base * e1) AS at1 FROM p JOIN pairs USING (i, j) GROUP BY i)"""


def _update() -> str:
    eps = "2.220446049250313e-16"
    return f"""WITH {UNIFORM_MEAN}, {_pairs()}, {FORCES}, {PULL},
grad AS (SELECT f.i AS id, 12.0 * coalesce(at0, 0) - f0 / ((SELECT sum(z) FROM forces) + {eps}) AS g0,
                12.0 * coalesce(at1, 0) - f1 / ((SELECT sum(z) FROM forces) + {eps}) AS g1
         FROM forces f LEFT JOIN pull USING (i)),
gains AS (SELECT *, CASE WHEN sign(g0) <> 0 THEN 1.2 ELSE 0.81 END AS a0,
                 CASE WHEN sign(g1) <> 0 THEN 1.2 ELSE 0.81 END AS a1 FROM grad),
steps AS (SELECT *, -((SELECT count(*) FROM pos) / 12.0) * a0 * g0 AS s0,
                 -((SELECT count(*) FROM pos) / 12.0) * a1 * g1 AS s1 FROM gains),
cut AS (SELECT *, least(1.0, 5.0 / greatest(sqrt(s0 * s0 + s1 * s1), 1e-300)) AS c FROM steps)
SELECT id, round(y0 + s0 * c, 6) AS y0, round(y1 + s1 * c, 6) AS y1, round(s0 * c, 6) AS u0, round(s1 * c, 6) AS u1,
       a0::DOUBLE AS g0, a1::DOUBLE AS g1
FROM cut JOIN pos USING (id)"""


def oracles() -> dict[str, str]:
    z_weight = (
        "power(abs((r - avg(r) OVER (PARTITION BY sample)) / stddev_pop(r) OVER (PARTITION BY sample)), 0.25)"
    )
    two = [_calibrated("c1", Q.SCALES[0], FRESH, "nn"), _calibrated("c2", Q.SCALES[1], FRESH, "nn")]
    linked = [_calibrated("c1", Q.SCALES[0], FRESH, "nn"), _calibrated("c2", Q.SCALES[1], "lo, hi", "c1_end")]
    out = {
        "ssgsea_rank": _plain(),
        "ssgsea_walk": WALK,
        "ssgsea_alpha1": _plain(weight="r"),
        "ssgsea_alpha0": _plain(weight="1.0"),
        "ssgsea_alpha_07": _plain(weight="power(r, 0.7)"),
        "ssgsea_zscore": _plain(weight=z_weight),
        "ssgsea_sizes": _plain(having="count(*) BETWEEN 75 AND 90"),
        "ssgsea_sample_z": f"""WITH {_scores()}
            SELECT sample, set_name, round((score - avg(score) OVER g) / stddev_pop(score) OVER g, 6) AS score
            FROM scores WINDOW g AS (PARTITION BY sample)""",
        "ssgsea_range": f"""WITH {_scores()}
            SELECT sample, set_name, round(score / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM scores""",
        "ssgsea_bucketed": f"WITH {EXPR} SELECT sample, row_idx, q, round(r, 6) AS avg_rank FROM ranked",
        "ssgsea_prefix": _plain(where="""p_brand IN (SELECT p_brand FROM part GROUP BY 1
            HAVING count(*) BETWEEN 4 AND 10000 ORDER BY 1 LIMIT 10)"""),
        "ssgsea_matrix": f"""WITH {_scores(member='p_type')}
            SELECT sample, '{{' || string_agg('"' || set_name || '":' || CAST(CAST(round(score, 6) AS DECIMAL(20, 6)) AS VARCHAR),
                ',' ORDER BY set_name) || '}}' AS scores FROM scores GROUP BY sample""",
        "ssgsea_checksum": f"""WITH {_scores()} SELECT round(sum(score), 4) AS checksum,
            count(DISTINCT sample) AS n_samples, count(DISTINCT set_name) AS n_sets FROM scores""",
        "avg_rank": f"WITH {EXPR} SELECT sample, row_idx, r AS avg_rank FROM ranked",
        "stable_ordinal": f"WITH {EXPR} SELECT sample, row_idx, q FROM ranked",
        "dup_mean": f"""WITH {EXPR} SELECT sample, p_brand AS gene, min(row_idx) AS row_idx,
            round(avg(value), 6) AS value FROM expr GROUP BY 1, 2""",
        "set_overlap": """SELECT p_brand AS set_name, count(*) AS matched FROM part GROUP BY 1
            HAVING count(*) BETWEEN 15 AND 500""",
        "align_sets": f"""WITH {EXPR} SELECT p_brand AS set_name, count(*) AS n_genes FROM part
            WHERE p_partkey IN (SELECT row_idx FROM expr WHERE value > 0) GROUP BY 1""",
        "align_expression": f"""WITH {EXPR} SELECT sample, count(*) AS n_rows, round(sum(value), 4) AS total
            FROM expr WHERE value > 0 GROUP BY 1""",
        "knn_query": f"WITH {_knn(Q.K_NEAR, pair=SPLIT)} {KNN_OUT}",
        "knn_pruned": f"WITH {_knn(Q.K_NEAR)} {KNN_OUT}",
        "knn_precomputed": f"WITH {_knn(Q.K_NEAR)} {KNN_OUT}",
        "graph_normalise": f"WITH {GRAPH} SELECT x, y FROM edges",
        "degree": f"WITH {GRAPH} SELECT p.id AS v, count(s) AS degree FROM pts p LEFT JOIN adj ON s = p.id GROUP BY 1",
        "degree_hist": f"""WITH {GRAPH}, d AS (SELECT p.id, count(s) AS degree FROM pts p LEFT JOIN adj ON s = p.id
            GROUP BY 1) SELECT degree, count(*) AS n_nodes FROM d GROUP BY 1""",
        "bipartite_degree": f"WITH {BIP} SELECT s AS v, count(*) AS degree FROM adj GROUP BY 1",
        "bipartite_squares": f"""WITH {BIP},
            walks AS (SELECT a.s AS u, a.d AS c, b.d AS w FROM adj a JOIN adj b ON b.s = a.d WHERE a.s <> b.d),
            cod AS (SELECT u, w, count(*) AS n FROM walks GROUP BY 1, 2)
            SELECT least(u, c) AS x, greatest(u, c) AS y, sum(n - 1)::BIGINT AS squares
            FROM walks JOIN cod USING (u, w) WHERE u < c GROUP BY 1, 2 HAVING sum(n - 1) > 0""",
        "edge_triangles": f"""WITH {GRAPH} SELECT e.x, e.y, count(b.d) AS triangles FROM edges e
            LEFT JOIN adj a ON a.s = e.x LEFT JOIN adj b ON b.s = e.y AND b.d = a.d GROUP BY 1, 2""",
        "codegree": f"""WITH {GRAPH} SELECT a.d AS x, b.d AS z, count(*) AS codegree
            FROM adj a JOIN adj b ON a.s = b.s AND a.d < b.d GROUP BY 1, 2""",
        "orbits4_nodes": f"WITH {_node_orbits(4)} SELECT * FROM wide",
        "orbits5_nodes": f"WITH {_node_orbits(5)} SELECT * FROM wide",
        "orbits4_edges": _edge_orbits(4),
        "orbits5_edges": _edge_orbits(5),
        "orbit_histogram": f"""WITH {_node_orbits(4)},
            long AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (v)) INTO NAME orbit VALUE n_touching)
            SELECT orbit, n_touching, count(*) AS n_nodes FROM long GROUP BY 1, 2""",
        "uniform_max": f"""WITH {_knn(Q.K_NEAR)},
            e AS (SELECT DISTINCT i, j FROM (SELECT i, j FROM knn UNION ALL SELECT j, i FROM knn))
            SELECT i, j, round(1.0::DOUBLE / count(*) OVER (), 9) AS p FROM e""",
        "uniform_mean": f"WITH {UNIFORM_MEAN} {P_OUT}",
        "fixed_sigma": f"""WITH {_knn(Q.K_NEAR)},
            g AS (SELECT i, j, exp(-d * d / (2 * {Q.SIGMA} * {Q.SIGMA})) AS w FROM knn),
            c AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS p FROM g), {_sym('p', 'c')} {P_OUT}""",
        "perplexity_p": f"""WITH RECURSIVE {_knn(30)}, {LISTS}, {_calibrated('c1', Q.PERPLEXITY, FRESH, 'nn')},
            {_kernel_rows('k', ['c1_end'])}, {_sym('p', 'k')} {P_OUT}""",
        "mixture_p": f"""WITH RECURSIVE {_knn(30)}, {LISTS}, {linked[0]}, {linked[1]},
            {_kernel_rows('k', ['c1_end', 'c2_end'])}, {_sym('p', 'k')} {P_OUT}""",
        "multiscale_avg": f"""WITH RECURSIVE {_knn(30)}, {LISTS}, {two[0]}, {two[1]},
            {_kernel_rows('k1', ['c1_end'])}, {_sym('p1', 'k1')}, {_kernel_rows('k2', ['c2_end'])}, {_sym('p2', 'k2')},
            both_p AS (SELECT i, j, sum(p) AS p FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY 1, 2)
            SELECT i, j, round(p / sum(p) OVER (), 9) AS p FROM both_p""",
        "to_new_p": f"""WITH RECURSIVE {_knn(15, pair=SPLIT)}, {LISTS}, {_calibrated('c1', 5.0, FRESH, 'nn')},
            {_kernel_rows('k', ['c1_end'])} SELECT i, j, round(p, 7) AS p FROM k""",
        "median_init": f"""WITH {_knn(Q.K_NEAR, pair=SPLIT)}, {POS} SELECT i AS id, round(median(y0), 6) AS y0,
            round(median(y1), 6) AS y1 FROM knn JOIN pos ON pos.id = j GROUP BY 1""",
        "weighted_init": f"""WITH {_knn(Q.K_NEAR, pair=SPLIT)}, {POS} SELECT i AS id,
            round(sum(d * y0) / sum(d), 6) AS y0, round(sum(d * y1) / sum(d), 6) AS y1
            FROM knn JOIN pos ON pos.id = j GROUP BY 1""",
        "attraction": f"WITH {UNIFORM_MEAN}, {_pairs()}, {PULL} SELECT i, round(at0, 9) AS at0, round(at1, 9) AS at1 FROM pull",
        "repulsion_exact": f"""WITH {_pairs()}, {FORCES} SELECT i AS id, round(z, 5) AS z, round(f0, 5) AS f0,
            round(f1, 5) AS f1 FROM forces""",
        "sum_q": f"WITH {_pairs(0.8)} SELECT round(sum(power(base, 0.8)), 4) AS sum_q FROM pairs",
        "kl_exact": f"""WITH {UNIFORM_MEAN}, {_pairs()}
            SELECT round(sum(p * ln(p / base)) + ln((SELECT sum(base) FROM pairs)) * sum(p), 6) AS kl
            FROM p JOIN pairs USING (i, j)""",
        "update_step": _update(),
        "clip_disc": f"""WITH {POS} SELECT id, round(y0 * least(1.0, 2.0 / greatest(sqrt(y0 * y0 + y1 * y1), 1e-300)), 6) AS y0,
            round(y1 * least(1.0, 2.0 / greatest(sqrt(y0 * y0 + y1 * y1), 1e-300)), 6) AS y1 FROM pos""",
    }
    out["orbits4_enumerated"] = out["orbits4_nodes"]
    out["ssgsea_gsva"] = out["ssgsea_range"]
    found = "SELECT count(*) * {k} AS n_found, true AS same_distances, true AS recall_reached, true AS \"full\" FROM embeddings WHERE {w}"
    out["forest_recall"] = out["descent_recall"] = found.format(k=Q.K_NEAR, w="true")
    out["forest_query_recall"] = found.format(k=Q.K_NEAR, w="label < 2")
    out["knn_sparse_cosine"], out["knn_sparse_jaccard"] = _sparse("cosine"), _sparse("jaccard")
    out["bh_exact_limit"] = out["repulsion_exact"]
    out["bh_repulsion"] = out["bh_joined"] = layout_sql.tree(POS, 0.5)
    out["fft_repulsion"] = layout_sql.grid(POS)
    for m in (*DIST, *MADE):
        out[f"knn_{m}"] = f"WITH {_knn(Q.K_NEAR, m)} {KNN_OUT}"
    for k in (3, 4, 5):
        out[f"k{k}_nodes"] = _cliques(k)
    first: dict[int, tuple[int, int]] = {}
    for o, (g, many) in patterns.orbit_multiplicity().items():
        if o > 0:
            first.setdefault(g, (o, many))
    sums = " UNION ALL ".join(
        f"SELECT {g} AS graphlet, (sum(o{o}) // {many})::BIGINT AS n FROM wide" for g, (o, many) in first.items()
    )
    out["graphlet_totals"] = f"WITH {_node_orbits(5)} {sums}"
    return out
