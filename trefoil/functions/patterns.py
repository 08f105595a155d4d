"""Orbit taxonomy of connected graphs on 2..5 nodes and the exact linear systems built from it.

Only the numbering is a fixed convention; every coefficient is derived here by counting maps. For
a pattern F rooted at a node (or edge), the number of homomorphisms that send the root to a place
in a big graph splits by the induced subgraph they cover:

    hom(F) = sum over rooted induced patterns G of  onto(F, G) * induced(G)

where ``onto`` counts root-preserving homomorphisms F -> G that hit every node of G. Choosing one
F per orbit gives a square invertible system.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import gcd

# The standard numbering of graphlets and their node orbits.
# graphlet: (edges, orbit of each node)
GRAPHLETS = {
    0: ("01", (0, 0)),
    1: ("01 12", (1, 2, 1)),
    2: ("01 02 12", (3, 3, 3)),
    3: ("01 12 23", (4, 5, 5, 4)),
    4: ("01 02 03", (7, 6, 6, 6)),
    5: ("01 12 23 03", (8, 8, 8, 8)),
    6: ("01 12 13 23", (9, 11, 10, 10)),
    7: ("01 02 12 13 23", (12, 13, 13, 12)),
    8: ("01 02 03 12 13 23", (14, 14, 14, 14)),
    9: ("01 12 23 34", (15, 16, 17, 16, 15)),
    10: ("01 12 23 24", (18, 20, 21, 19, 19)),
    11: ("01 02 03 04", (23, 22, 22, 22, 22)),
    12: ("01 12 13 23 24", (24, 26, 26, 25, 24)),
    13: ("01 12 23 24 34", (27, 28, 30, 29, 29)),
    14: ("01 02 03 04 34", (33, 31, 31, 32, 32)),
    15: ("01 12 23 34 04", (34, 34, 34, 34, 34)),
    16: ("01 12 23 34 14", (35, 38, 37, 36, 37)),
    17: ("01 12 13 14 23 34", (39, 42, 40, 41, 40)),
    18: ("01 02 12 03 04 34", (44, 43, 43, 43, 43)),
    19: ("01 12 13 23 24 34", (45, 47, 48, 48, 46)),
    20: ("02 03 04 12 13 14", (50, 50, 49, 49, 49)),
    21: ("01 12 23 03 04 14", (53, 53, 51, 51, 52)),
    22: ("01 02 03 04 12 13 14", (55, 55, 54, 54, 54)),
    23: ("01 12 13 14 23 24 34", (56, 58, 57, 57, 57)),
    24: ("01 02 03 04 12 23 34", (61, 59, 60, 60, 59)),
    25: ("02 03 04 12 13 14 23", (63, 63, 64, 64, 62)),
    26: ("01 02 03 12 13 23 04 14", (67, 67, 66, 66, 65)),
    27: ("01 02 03 04 12 23 34 14", (69, 68, 68, 68, 68)),
    28: ("01 02 03 04 12 13 14 23 24", (71, 71, 71, 70, 70)),
    29: ("01 02 03 04 12 13 14 23 24 34", (72, 72, 72, 72, 72)),
}

N_NODE_ORBITS = {4: 15, 5: 73}
N_EDGE_ORBITS = {4: 12, 5: 68}


def parse(edges: str) -> list[tuple[int, int]]:
    return [(int(e[0]), int(e[1])) for e in edges.split()]


def size_of(edges: list[tuple[int, int]]) -> int:
    return 1 + max(max(e) for e in edges)


def adjacency(edges: list[tuple[int, int]], k: int) -> list[set[int]]:
    nbrs: list[set[int]] = [set() for _ in range(k)]
    for a, b in edges:
        nbrs[a].add(b)
        nbrs[b].add(a)
    return nbrs


@lru_cache(maxsize=None)
def node_orbits() -> dict[int, tuple[int, int]]:
    """orbit -> (graphlet, representative node)."""
    out: dict[int, tuple[int, int]] = {}
    for g, (_, orbits) in GRAPHLETS.items():
        for node, o in enumerate(orbits):
            out.setdefault(o, (g, node))
    return dict(sorted(out.items()))


@lru_cache(maxsize=None)
def edge_orbits() -> dict[int, tuple[int, int, int]]:
    """edge orbit -> (graphlet, node, node).

    Numbered by graphlet from the 3-node path on, then by the (low, high) node orbits of the ends;
    that pair is unique to one edge orbit. Key -1 is the single edge, which has no output column.
    """
    out = {-1: (0, 0, 1)}
    for g, (text, orbits) in GRAPHLETS.items():
        if g == 0:
            continue
        ends: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b in parse(text):
            lo, hi = sorted((orbits[a], orbits[b]))
            ends.setdefault((lo, hi), (a, b))
        for key in sorted(ends):
            out[len(out) - 1] = (g, *ends[key])
    return out


def orbit_multiplicity() -> dict[int, tuple[int, int]]:
    """node orbit -> (graphlet, how many nodes of the graphlet lie in it)."""
    return {
        o: (g, GRAPHLETS[g][1].count(o)) for o, (g, _) in node_orbits().items()
    }


def _onto_maps(f_edges, f_size: int, g: int, fixed: list[tuple[int, ...]]) -> int:
    """Homomorphisms F -> graphlet g hitting every node, roots 0.. mapped to each of ``fixed``."""
    g_edges = parse(GRAPHLETS[g][0])
    k = size_of(g_edges)
    if k > f_size:
        return 0
    nbrs = adjacency(g_edges, k)
    earlier = [[b for a, b in f_edges if a == x and b < x] + [a for a, b in f_edges if b == x and a < x]
               for x in range(f_size)]
    total = 0

    def extend(image: tuple[int, ...]) -> int:
        x = len(image)
        if x == f_size:
            return 1 if len(set(image)) == k else 0
        if k - len(set(image)) > f_size - x:
            return 0
        return sum(
            extend(image + (y,)) for y in range(k) if all(y in nbrs[image[z]] for z in earlier[x])
        )

    for start in fixed:
        if all(start[b] in nbrs[start[a]] for a, b in f_edges if a < len(start) and b < len(start)):
            total += extend(tuple(start))
    return total


def _invert(matrix: list[list[int]]) -> list[tuple[list[int], int]]:
    """Rows of the inverse as (integer coefficients, denominator)."""
    n = len(matrix)
    rows = [
        [Fraction(x) for x in r] + [Fraction(int(i == j)) for j in range(n)]
        for i, r in enumerate(matrix)
    ]
    for c in range(n):
        pivot = next(r for r in range(c, n) if rows[r][c] != 0)
        rows[c], rows[pivot] = rows[pivot], rows[c]
        lead = rows[c][c]
        rows[c] = [x / lead for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c] != 0:
                factor = rows[r][c]
                rows[r] = [x - factor * y if y else x for x, y in zip(rows[r], rows[c])]
    out = []
    for r in rows:
        inverse = r[n:]
        den = 1
        for x in inverse:
            den = den * x.denominator // gcd(den, x.denominator)
        out.append(([int(x * den) for x in inverse], den))
    return out


def solve_edges(features: dict[str, str], size: int) -> dict[int, tuple[dict[str, int], int]]:
    """edge orbit -> ({feature: coefficient}, denominator).

    A feature is a pattern rooted at the directed edge (0, 1); its value for an undirected edge is
    the sum over both directions.
    """
    targets = {
        o: v for o, v in edge_orbits().items() if len(GRAPHLETS[v[0]][1]) <= size
    }
    names = list(features)
    matrix = []
    for name in names:
        edges = parse(features[name])
        k = size_of(edges)
        matrix.append(
            [_onto_maps(edges, k, g, [(a, b), (b, a)]) for g, a, b in targets.values()]
        )
    inverse = _invert(matrix)
    return {
        o: ({n: c for n, c in zip(names, coeffs) if c}, den)
        for o, (coeffs, den) in zip(targets, inverse)
        if o >= 0
    }


def class_of_root(edges: list[tuple[int, int]], root: int) -> int:
    """Node orbit of ``root`` in the pattern."""
    k = size_of(edges)
    nbrs = adjacency(edges, k)
    wanted = {frozenset(e) for e in edges}
    for g, (text, orbits) in GRAPHLETS.items():
        candidate = parse(text)
        if len(orbits) != k or len(candidate) != len(wanted):
            continue
        degrees = sorted(len(x) for x in adjacency(candidate, k))
        if degrees != sorted(len(x) for x in nbrs):
            continue
        for p in permutations(range(k)):
            if {frozenset((p[a], p[b])) for a, b in edges} == {frozenset(e) for e in candidate}:
                return orbits[p[root]]
    raise ValueError("pattern is not connected")


def pick_node_features(features: dict[str, str]) -> dict[int, tuple[str, int]]:
    """node orbit -> (edge feature, end of its root edge standing at that orbit)."""
    chosen: dict[int, tuple[str, int]] = {}
    for name, text in features.items():
        edges = parse(text)
        for end in (0, 1):
            chosen.setdefault(class_of_root(edges, end), (name, end))
    return dict(sorted(chosen.items()))


def solve_nodes(features: dict[str, str], size: int):
    """(picked features, node orbit -> ({picked orbit: coefficient}, denominator))."""
    picked = pick_node_features(features)
    targets = {o: v for o, v in node_orbits().items() if len(GRAPHLETS[v[0]][1]) <= size}
    picked = {o: picked[o] for o in targets}
    matrix = []
    for name, end in picked.values():
        edges = parse(features[name])
        if end == 1:
            swap = {0: 1, 1: 0}
            edges = [(swap.get(a, a), swap.get(b, b)) for a, b in edges]
        matrix.append(
            [_onto_maps(edges, size_of(edges), g, [(node,)]) for g, node in targets.values()]
        )
    inverse = _invert(matrix)
    order = list(picked)
    return picked, {
        o: ({p: c for p, c in zip(order, coeffs) if c}, den)
        for o, (coeffs, den) in zip(targets, inverse)
    }
