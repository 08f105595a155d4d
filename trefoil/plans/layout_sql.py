"""DuckDB SQL of the approximate repulsions: the cell tree walked row by row, and the grid summed node against node."""

from __future__ import annotations

EPS = "2.220446049250313e-16"
DEPTH = 26
BUCKET = 8

# pos(id, y0, y1) comes from the caller.
_CELLS = f"""
cube AS (SELECT min(y0) AS l0, min(y1) AS l1,
                greatest(max(y0) - min(y0), max(y1) - min(y1)) * (1 + 1e-9) + 1e-12 AS side FROM pos),
fine AS (SELECT id, y0, y1,
                CAST(greatest(0, least(floor((y0 - l0) / side * {2.0 ** DEPTH}), {2 ** DEPTH - 1})) AS BIGINT) AS k0,
                CAST(greatest(0, least(floor((y1 - l1) / side * {2.0 ** DEPTH}), {2 ** DEPTH - 1})) AS BIGINT) AS k1
         FROM pos, cube),
paths AS (SELECT y0, y1, CAST(lv AS BIGINT) AS lv, k0 >> ({DEPTH} - lv) AS k0, k1 >> ({DEPTH} - lv) AS k1
          FROM (SELECT y0, y1, k0, k1, CAST(unnest(range(0, {DEPTH + 1})) AS INTEGER) AS lv FROM fine)),
cells AS (SELECT lv, k0, k1, count(*) AS n,
                 CASE WHEN min(y0) = max(y0) AND min(y1) = max(y1) THEN min(y0) ELSE avg(y0) END AS m0,
                 CASE WHEN min(y0) = max(y0) AND min(y1) = max(y1) THEN min(y1) ELSE avg(y1) END AS m1,
                 (min(y0) = max(y0) AND min(y1) = max(y1)) OR lv = {DEPTH} AS leaf
          FROM paths GROUP BY lv, k0, k1)"""


def tree(pos: str, theta: float) -> str:
    """``id, z, f0, f1`` of every position, opening a cell when side / distance >= theta."""
    return f"""WITH RECURSIVE {pos}, {_CELLS},
walk AS (
  SELECT id, y0, y1, k0 AS own0, k1 AS own1, CAST(0 AS BIGINT) AS lv, CAST(0 AS BIGINT) AS k0, CAST(0 AS BIGINT) AS k1,
         0.0::DOUBLE AS g0, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS n, (SELECT count(*) FROM pos) AS members, true AS opened FROM fine
  UNION ALL
  SELECT id, y0, y1, own0, own1, lv, k0, k1, g0, g1, n, members,
         NOT leaf AND power(side / power(2.0, lv), 2) >= {theta * theta} * (g0 * g0 + g1 * g1 + {EPS}) AS opened
  FROM (SELECT w.id, w.y0, w.y1, w.own0, w.own1, c.lv, c.k0, c.k1, c.leaf, side, c.n AS members, c.n - own AS n,
               w.y0 - CASE WHEN own = 1 AND c.n > 1 THEN c.m0 + (c.m0 - w.y0) / (c.n - 1) ELSE c.m0 END AS g0,
               w.y1 - CASE WHEN own = 1 AND c.n > 1 THEN c.m1 + (c.m1 - w.y1) / (c.n - 1) ELSE c.m1 END AS g1
        FROM walk w JOIN cells c ON c.lv = CASE WHEN w.members > {BUCKET} THEN w.lv + 1 ELSE {DEPTH} END
               AND c.k0 >> CAST(c.lv - w.lv AS INTEGER) = w.k0 AND c.k1 >> CAST(c.lv - w.lv AS INTEGER) = w.k1, cube,
             LATERAL (SELECT CASE WHEN c.leaf AND w.own0 >> CAST({DEPTH} - c.lv AS INTEGER) = c.k0
                                   AND w.own1 >> CAST({DEPTH} - c.lv AS INTEGER) = c.k1 THEN 1 ELSE 0 END AS own) o
        WHERE w.opened) x)
SELECT id, round(sum(n * q), 5) AS z, round(sum(n * q * q * g0), 5) AS f0, round(sum(n * q * q * g1), 5) AS f1
FROM (SELECT *, 1 / (1 + (g0 * g0 + g1 * g1 + {EPS})) AS q FROM walk WHERE NOT opened) GROUP BY id"""


def _weight(t: str, m: int) -> str:
    nodes = [(k + 0.5) / 3 for k in range(3)]
    parts = [f"(({t} - {n!r}) / {nodes[m] - n!r})" for k, n in enumerate(nodes) if k != m]
    return " * ".join(parts)


def grid(pos: str) -> str:
    """``id, z, f0, f1`` by three-point interpolation; only nodes of occupied boxes hold charge or are asked."""
    box = lambda c: f"greatest(0, least(floor((y{c} - o{c}) / width), b{c} - 1))"
    weights = ", ".join(f"[{', '.join(_weight(f't{c}', m) for m in range(3))}] AS w{c}" for c in (0, 1))
    return f"""WITH {pos},
smooth AS (SELECT DISTINCT CAST(power(2, a) * power(3, b) * power(5, c) * power(7, d) * e AS BIGINT) AS n
  FROM unnest(range(0, 10)) AS x1(a), unnest(range(0, 7)) AS x2(b), unnest(range(0, 5)) AS x3(c), unnest(range(0, 4)) AS x4(d),
       unnest([1, 11, 13]) AS x5(e) WHERE power(2, a) * power(3, b) * power(5, c) * power(7, d) * e <= 1000),
ends AS (SELECT min(y0) AS l0, min(y1) AS l1, max(y0) AS h0, max(y1) AS h1, least(min(y0), min(y1)) AS l,
                greatest(max(y0), max(y1)) - least(min(y0), min(y1)) AS extent FROM pos),
wide AS (SELECT ends.*, (SELECT min(n) FROM smooth WHERE n >= floor(greatest(50.0, extent))) AS total FROM ends),
cut AS (SELECT *, extent / total AS width FROM wide),
first AS (SELECT *, floor((l0 - l) / width) AS i0, floor((l1 - l) / width) AS i1 FROM cut),
sized AS (SELECT width, l + i0 * width AS o0, l + i1 * width AS o1,
    least(floor((h0 - l) / width), total - 1) - i0 + 1 AS need0, least(floor((h1 - l) / width), total - 1) - i1 + 1 AS need1 FROM first),
g AS (SELECT width, o0, o1, (SELECT min(n) FROM smooth WHERE n >= greatest(20, need0)) AS b0,
             (SELECT min(n) FROM smooth WHERE n >= greatest(20, need1)) AS b1 FROM sized),
boxed AS (SELECT id, y0, y1, width, {box(0)} AS x0, {box(1)} AS x1, o0, o1 FROM pos, g),
placed AS (SELECT *, (y0 - o0) / width - x0 AS t0, (y1 - o1) / width - x1 AS t1 FROM boxed),
near AS (SELECT id, y0, y1, x0 * 3 + m0 AS k0, x1 * 3 + m1 AS k1, w0[m0 + 1] * w1[m1 + 1] AS w
         FROM (SELECT id, y0, y1, x0, x1, {weights} FROM placed), unnest([0, 1, 2]) AS u0(m0), unnest([0, 1, 2]) AS u1(m1)),
charge AS (SELECT k0, k1, sum(w) AS c, sum(w * y0) AS c0, sum(w * y1) AS c1 FROM near GROUP BY k0, k1),
met AS (SELECT a.k0, a.k1, b.c, b.c0, b.c1,
               1 / (1 + ((a.k0 - b.k0) * (a.k0 - b.k0) + (a.k1 - b.k1) * (a.k1 - b.k1)) * width / 3 * width / 3) AS q
        FROM charge a, charge b, g),
felt AS (SELECT k0, k1, sum(q * c) AS s, sum(q * q * c) AS p, sum(q * q * c0) AS p0, sum(q * q * c1) AS p1 FROM met GROUP BY k0, k1)
SELECT id, round(sum(w * s) - 1, 4) AS z, round(any_value(y0) * sum(w * p) - sum(w * p0), 4) AS f0,
       round(any_value(y1) * sum(w * p) - sum(w * p1), 4) AS f1
FROM near JOIN felt USING (k0, k1) GROUP BY id"""
