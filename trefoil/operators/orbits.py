"""Node and edge orbit counts of all connected graphs on up to 4 or 5 nodes.

One wide per-directed-edge table of rooted pattern counts feeds both results: edge orbits add the
two directions, node orbits add over a node's edges, and one exact integer projection (derived in
``functions.patterns``) turns pattern counts into induced counts. No 5-node subgraph is ever
enumerated: the widest rows are triangles, wedges, diamonds and cliques.

Cost: 4-node counts need sum(min(deg)) rows. 5-node counts list walks through ordinary centres only;
hubs (above ``hub_degree``, so at most 2m / hub_degree of them) enter through each node's short hub
list and through tables between hubs, so no task or stage sees all pairs of a hub's neighbours.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trefoil.functions import patterns
from trefoil.functions.features import LARGE, SMALL
from trefoil.operators import graph as G
from trefoil.session import cut_lineage


# Nodes above this degree are hubs: their walks are never listed. At most 2m / HUB_DEGREE exist.
HUB_DEGREE = 20_000


@lru_cache(maxsize=None)
def _systems(size: int):
    features = SMALL if size == 4 else LARGE
    picked, nodes = patterns.solve_nodes(features, size)
    return picked, nodes, patterns.solve_edges(features, size)


class OrbitCounts:
    """Shared pattern table of one graph, written to the checkpoint folder stage by stage."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, size: int = 5,
                 chunk: int = G.HUB_CHUNK, wide: bool = False, hub_degree: int = HUB_DEGREE):
        """``edges(edge_id, x, y)`` from ``clean_edges``; ``nodes(v)`` adds isolated nodes.

        ``wide`` computes the final combination in decimals, for counts beyond 2^63 (the long path
        raises an overflow error instead of wrapping).
        """
        if size not in (4, 5):
            raise ValueError("size must be 4 or 5")
        self.size, self.chunk, self.wide, self.hub_degree = size, chunk, wide, hub_degree
        self.edges = cut_lineage(edges.select("edge_id", "x", "y"))
        self.given_nodes = nodes
        self.table = cut_lineage(self._pattern_table())

    # -- pattern table ---------------------------------------------------------------------

    def _pattern_table(self) -> DataFrame:
        two = cut_lineage(G.with_degrees(self.edges))
        arcs = G.oriented(two)
        outs = cut_lineage(G.out_lists(arcs))
        tri = cut_lineage(G.triangle_list(arcs, outs))
        quads = cut_lineage(G.clique4_list(tri, outs))

        te = G.edge_membership(tri, ["a", "b", "c"], "te")
        base = cut_lineage(
            G.both_ways(
                two.join(te, ["x", "y"], "left").fillna(0, subset=["te"]), "te"
            )
            .join(G.degrees(self.edges).toDF("u", "du"), "u")
            .join(G.degrees(self.edges).toDF("v", "dv"), "v")
        )
        # First sums over a node's edges.
        node = base.groupBy("u").agg(
            F.first("du").alias("d"),
            F.sum("dv").alias("p"),
            F.sum(F.col("dv") * F.col("dv")).alias("s"),
            F.sum("te").alias("t"),
            F.sum(F.col("te") * F.col("dv")).alias("td"),
            F.sum(F.col("te") * F.col("te")).alias("dm3"),
        )
        node = cut_lineage(node)
        e = cut_lineage(
            base.join(node.select(F.col("u").alias("v"), F.col("p").alias("pv"), F.col("t").alias("tv")), "v")
        )

        squares = G.edge_squares(two, self.chunk)
        w3 = G.both_ways(squares, "squares")
        k4 = G.both_ways(G.edge_membership(quads, ["a", "b", "c", "d"], "k4n"), "k4n")
        corners = self._rooted_triangles(tri)
        near = self._triangle_sums(corners, e)
        edge = (
            e.join(near, ["u", "v"], "left")
            .join(w3, ["u", "v"], "left")
            .join(k4, ["u", "v"], "left")
            .fillna(0)
            .withColumn("w3", F.col("squares") + F.col("du") + F.col("dv") - 1)
            .withColumn("k4e", 2 * F.col("k4n"))
        )
        if self.size == 4:
            return self._small_columns(edge)
        return self._large_columns(cut_lineage(edge), node, tri, corners, quads, outs)

    @staticmethod
    def _rooted_triangles(tri: DataFrame) -> DataFrame:
        """Every triangle as six rows: directed edge (u, v) and third node z."""
        names = ("a", "b", "c")
        perms = [(p, q, next(r for r in names if r not in (p, q))) for p in names for q in names if p != q]
        rows = F.array(*[
            F.struct(F.col(p).alias("u"), F.col(q).alias("v"), F.col(r).alias("z")) for p, q, r in perms
        ])
        return tri.select(F.explode(rows).alias("r")).select("r.*")

    def _triangle_sums(self, corners: DataFrame, e: DataFrame) -> DataFrame:
        """Sums over the common neighbours z of (u, v)."""
        far = e.select(
            F.col("u").alias("v"), F.col("v").alias("z"), F.col("te").alias("tvz"),
            F.col("dv").alias("dz"), F.col("pv").alias("pz"), F.col("tv").alias("tz"),
        )
        rows = corners.join(far, ["v", "z"])
        sums = [F.sum("dz").alias("ted"), F.sum("tvz").alias("m1")]
        if self.size == 5:
            side = e.select("u", F.col("v").alias("z"), F.col("te").alias("tuz"))
            rows = rows.join(side, ["u", "z"])
            sums += [
                F.sum("pz").alias("tep"),
                F.sum(F.col("dz") * F.col("dz")).alias("tedd"),
                F.sum("tz").alias("tet"),
                F.sum(F.col("tvz") * F.col("dz")).alias("m1d"),
                F.sum(F.col("tvz") * F.col("tvz")).alias("m1sq"),
                F.sum(F.col("tuz") * F.col("tvz")).alias("gem"),
            ]
        return rows.groupBy("u", "v").agg(*sums)

    @staticmethod
    def _small_exprs() -> dict[str, Column]:
        c = F.col
        return {
            "one": F.lit(1).cast("long"), "path3": c("dv"), "tri": c("te"), "path4_end": c("pv"),
            "path4_mid": c("du") * c("dv"), "claw": c("dv") * c("dv"), "c4": c("w3"),
            "paw_tail": c("tv"), "paw_far": c("ted"), "paw_side": c("te") * c("dv"),
            "diamond_rim": c("m1"), "diamond_spine": c("te") * c("te"), "k4": c("k4e"),
        }

    def _small_columns(self, edge: DataFrame) -> DataFrame:
        return edge.select("u", "v", *[x.alias(n) for n, x in self._small_exprs().items()])

    def _large_columns(self, edge, node, tri, corners, quads, outs) -> DataFrame:
        c = F.col
        # Second sums over a node's edges.
        more = edge.groupBy("u").agg(
            F.sum("pv").alias("q"), F.sum("tv").alias("at"), F.sum("w3").alias("c4n"),
            F.sum("m1").alias("dm2"), F.sum("k4e").alias("k4node"),
        )
        head = node.join(more, "u").select(
            c("u").alias("v"), c("s").alias("sv"), c("td").alias("tdv"), c("dm3").alias("dm3v"),
            c("q").alias("qv"), c("at").alias("atv"), c("c4n").alias("c4v"), c("dm2").alias("dm2v"),
            c("k4node").alias("k4v"),
        )
        parts = [
            self._triangle_second_sums(edge, tri, corners, quads),
            self._wedge_sums(edge, corners),
            self._clique_sums(edge, quads, outs),
        ]
        full = edge.join(head, "v")
        for part in parts:
            full = full.join(part, ["u", "v"], "left")
        full = full.fillna(0)
        exprs = self._small_exprs() | {
            "path5_end": c("qv"), "path5_mid": c("du") * c("pv"), "fork_tail": c("sv"),
            "fork_leaf": c("dv") * c("pv"), "fork_mid": c("du") * c("dv") * c("dv"),
            "star": c("dv") * c("dv") * c("dv"), "bull_tail": c("tdv"),
            "bull_side": c("dv") * c("ted"), "bull_base": c("te") * c("du") * c("dv"),
            "tadpole_end": c("atv"), "tadpole_mid": c("du") * c("tv"), "tadpole_far": c("tep"),
            "tadpole_side": c("te") * c("pv"), "cricket_leaf": c("dv") * c("tv"),
            "cricket_far": c("tedd"), "cricket_side": c("te") * c("dv") * c("dv"), "c5": c("w4"),
            "banner_tail": c("c4v"), "banner_far": c("w3d"), "banner_side": c("w3") * c("dv"),
            "dart_tail": c("dm3v"), "dart_rim": c("m1d"), "dart_side": c("m1") * c("dv"),
            "dart_spine": c("te") * c("te") * c("dv"), "butterfly_far": c("tet"),
            "butterfly_side": c("te") * c("tv"), "kite_tail": c("dm2v"), "kite_far": c("z_ted"),
            "kite_side": c("du") * c("m1"), "kite_spine": c("te") * c("ted"), "k23": c("k23"),
            "house_roof": c("z_w3"), "house_beam": c("te") * c("w3"), "house_wall": c("wall"),
            "house_floor": c("floor_"), "book_page": c("m1sq"),
            "book_spine": c("te") * c("te") * c("te"), "k4_tail": c("k4v"), "k4_tail_far": c("k4d"),
            "k4_tail_side": c("k4e") * c("dv"), "gem_end": c("z_m1"), "gem_side": c("z_m1r"),
            "gem_mid": c("gem"), "gem_spoke": c("te") * c("m1"), "k23e_tip": c("tip"),
            "k23e_side": c("k23e_side"), "k23e_base": c("k23e_base"), "k4_cap_tip": c("z_k4e"),
            "k4_cap_base": c("cap_base"), "k4_cap_side": c("cap_side"),
            "k4_cap_spine": c("te") * c("k4e"), "wheel_rim": c("rim"), "wheel_spoke": c("spoke"),
            "k5e_side": c("k5e_side"), "k5e_core": c("k5e_core"), "k5": c("k5"),
        }
        return full.select("u", "v", *[exprs[n].alias(n) for n in LARGE])

    def _triangle_second_sums(self, edge, tri, corners, quads) -> DataFrame:
        """Sums over common neighbours z of values of the edge (v, z)."""
        back = edge.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("m1").alias("m1r"))
        far = edge.join(back, ["u", "v"]).select(
            F.col("u").alias("v"), F.col("v").alias("z"), "ted", "w3", "m1", "m1r", "k4e"
        )
        sums = corners.join(far, ["v", "z"]).groupBy("u", "v").agg(
            *[F.sum(n).alias(f"z_{n}") for n in ("ted", "w3", "m1", "m1r", "k4e")]
        )
        # 4-cliques on each triangle, squared and summed over the triangles of an edge.
        on_tri = self._clique_triangles(quads)
        squared = (
            on_tri.select(
                F.explode(F.array(*G._pairs_of(["i", "j", "k"]))).alias("e"),
                (F.col("kt") * F.col("kt")).alias("sq"),
            )
            .groupBy(F.col("e.x").alias("x"), F.col("e.y").alias("y"))
            .agg(F.sum("sq").alias("k5e_core"))
        )
        return sums.join(G.both_ways(squared, "k5e_core"), ["u", "v"], "left")

    @staticmethod
    def _clique_triangles(quads: DataFrame) -> DataFrame:
        """``i < j < k, kt``: number of 4-cliques on each triangle that has any."""
        names = ["a", "b", "c", "d"]
        faces = [F.array_sort(F.array(*[n for n in names if n != out])) for out in names]
        return (
            quads.select(F.explode(F.array(*faces)).alias("f"))
            .groupBy("f")
            .agg(F.count(F.lit(1)).alias("kt"))
            .select(
                F.col("f")[0].alias("i"), F.col("f")[1].alias("j"), F.col("f")[2].alias("k"), "kt"
            )
        )

    def _wedge_sums(self, edge: DataFrame, corners: DataFrame) -> DataFrame:
        """Sums over walks u - v - b and over pairs of nodes two steps apart.

        Walks through an ordinary centre are listed. A hub's are not: what two nodes share through
        hubs is the overlap of their short hub lists, and sums over all pairs of a hub's neighbours
        fold into tables between hubs (``_hub_sums``).
        """
        c = F.col
        hubs = edge.filter(c("dv") > self.hub_degree)
        has_hubs = not hubs.isEmpty()
        links = edge.select("u", "v", "du", "dv", "te")
        ordinary = links.filter(c("du") <= self.hub_degree)
        walks = G.wedges(ordinary, [], [c("dv").alias("db"), c("te").alias("tcb")], self.chunk)
        # Diamonds on the spine (h, m), both wings ordered, wings may coincide.
        thick = corners.join(edge.select("u", "v", "te"), ["u", "v"]).withColumn("h", F.struct("u", "v"))
        wing = thick.select("h", "z", "te")
        diamonds = G.chunked_join(
            wing.withColumnRenamed("z", "a"), wing.withColumnRenamed("z", "b"), "h", "te", self.chunk
        ).select(c("h.u").alias("h"), c("h.v").alias("m"), "a", "b")
        triples = cut_lineage(diamonds.groupBy("h", "a", "b").agg(F.count(F.lit(1)).alias("c3")))
        linked = triples.groupBy(c("a").alias("u"), "b").agg(F.sum("c3").alias("dd"))
        seen = walks.groupBy("u", "b").agg(F.count(F.lit(1)).alias("own"), F.sum("tcb").alias("tt"))
        pairs = seen.join(linked, ["u", "b"], "full").fillna(0)
        lists = None
        if has_hubs:
            lists = cut_lineage(
                hubs.groupBy("u").agg(F.sort_array(F.collect_list(F.struct(c("v").alias("c"), c("te").alias("t")))).alias("hubs"))
            )
            pairs = self._with_hub_overlap(pairs, lists)
        else:
            pairs = pairs.withColumn("cd", c("own"))
        pairs = cut_lineage(pairs)
        # One row per (u, v); parts are added up at the end.
        parts = [walks.join(pairs, ["u", "b"]).groupBy("u", c("c").alias("v")).agg(
            F.sum(c("db") * c("cd")).alias("w3d"),
            F.sum(c("tcb") * c("cd")).alias("wall"),
            F.sum("tt").alias("floor_"),
            F.sum(c("cd") * c("cd")).alias("k23"),
            F.sum("dd").alias("tip"),
        )]
        cd = pairs.select(c("u").alias("a"), "b", "cd")
        parts.append(triples.join(cd, ["a", "b"]).groupBy(c("a").alias("u"), c("h").alias("v")).agg(
            F.sum(c("c3") * c("cd")).alias("k23e_side"), F.sum(c("c3") * c("c3")).alias("spoke")
        ))
        parts.append(diamonds.join(cd, ["a", "b"]).groupBy(c("h").alias("u"), c("m").alias("v")).agg(
            F.sum("cd").alias("k23e_base")
        ))
        parts.append(
            diamonds.join(triples, ["h", "a", "b"]).groupBy(c("a").alias("u"), c("m").alias("v")).agg(
                F.sum("c3").alias("rim")
            )
        )
        parts.append(self._five_walks(edge, pairs))
        if has_hubs:
            parts += self._hub_sums(edge, pairs, lists)
        names = ["w3d", "wall", "floor_", "k23", "tip", "k23e_side", "spoke", "k23e_base", "rim", "w4"]
        zero = F.lit(0).cast("long")
        stacked = [p.select("u", "v", *[c(n) if n in p.columns else zero.alias(n) for n in names]) for p in parts]
        return reduce(DataFrame.unionByName, stacked).groupBy("u", "v").agg(*[F.sum(n).alias(n) for n in names])

    def _five_walks(self, edge: DataFrame, pairs: DataFrame) -> DataFrame:
        """Closed walks of length 5 on an edge whose two-step pairs both avoid hub centres: joined
        from the end with fewer two-step pairs."""
        c = F.col
        reach = pairs.filter("own > 0").select("u", "b", c("own").alias("r1"))
        span = cut_lineage(reach.groupBy("u").agg(F.count(F.lit(1)).alias("_n")))
        ends = (
            edge.filter(c("u") < c("v")).select("u", "v")
            .join(span, "u").join(span.select(c("u").alias("v"), c("_n").alias("_m")), "v")
        )
        flip = c("_m") < c("_n")
        ends = ends.select(
            F.when(flip, c("v")).otherwise(c("u")).alias("u"), F.when(flip, c("u")).otherwise(c("v")).alias("v"),
            F.least("_n", "_m").alias("_n"),
        )
        near = reach.join(span, "u")
        five = (
            G.chunked_join(near, ends, "u", "_n", self.chunk)
            .join(reach.select(c("u").alias("v"), "b", c("r1").alias("r2")), ["v", "b"])
            .groupBy(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
            .agg(F.sum(c("r1") * c("r2")).alias("w4"))
        )
        return G.both_ways(five, "w4")

    @staticmethod
    def _with_hub_overlap(pairs: DataFrame, lists: DataFrame) -> DataFrame:
        """Add shared hubs of u and b (``both``, with the triangles of the hub's edge to b)."""
        c = F.col
        joined = pairs.join(lists.withColumnRenamed("hubs", "hu"), "u", "left").join(
            lists.select(c("u").alias("b"), c("hubs").alias("hb")), "b", "left"
        )
        ids = F.transform("hu", lambda x: x["c"])
        both = F.coalesce(F.filter("hb", lambda x: F.array_contains(ids, x["c"])), F.array())
        out = joined.withColumn("both", F.when(c("hu").isNull(), None).otherwise(both))
        shared = F.coalesce(F.when(c("both").isNotNull(), F.size("both")), F.lit(0))
        through = F.coalesce(
            F.aggregate("both", F.lit(0).cast("long"), lambda s, x: s + x["t"]), F.lit(0).cast("long")
        )
        return out.select(
            "u", "b", "own", "dd", c("tt").alias("tt_own"), (c("own") + shared).alias("cd"),
            (c("tt") + through).alias("tt"), "both", "hb",
        )

    def _hub_sums(self, edge: DataFrame, pairs: DataFrame, lists: DataFrame) -> list[DataFrame]:
        """What walks through hub centres add, without listing them."""
        c = F.col
        deg = edge.select("u", c("du").alias("d")).distinct()
        # Listed pairs that also share hub v: the part of v's pair sums with an ordinary share.
        listed = pairs.filter("size(both) > 0").join(deg.withColumnRenamed("u", "b"), "b").select(
            "u", "own", "dd", "tt_own", "cd", "d", F.explode("both").alias("h")
        )
        a = listed.groupBy("u", c("h.c").alias("v")).agg(
            F.sum(c("d") * c("own")).alias("w3d"),
            F.sum(c("h.t") * c("own")).alias("wall"),
            F.sum("tt_own").alias("floor_"),
            F.sum(c("cd") * c("cd") - (c("cd") - c("own")) * (c("cd") - c("own"))).alias("k23"),
            F.sum("dd").alias("tip"),
        )
        # Tables between hubs over their shared neighbours; hub lists are short (few hubs exist).
        near = lists.join(deg, "u")
        one = near.select("u", "d", "hubs", F.explode("hubs").alias("p"))
        two = one.select("u", "d", "hubs", "p", F.explode("hubs").alias("q"))
        hub2 = cut_lineage(two.groupBy(c("p.c").alias("p"), c("q.c").alias("q")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("d").alias("sd"), F.sum("p.t").alias("sp"), F.sum("q.t").alias("sq")
        ))
        three = two.select(c("p.c").alias("p"), c("q.c").alias("q"), F.explode("hubs").alias("r"))
        hub3 = three.groupBy("p", "q", c("r.c").alias("r")).agg(F.count(F.lit(1)).alias("n3"))
        own2 = two.select("u", c("p.c").alias("p"), c("q.c").alias("q"))
        b = own2.join(hub2, ["p", "q"]).groupBy("u", c("p").alias("v")).agg(
            F.sum("sd").alias("w3d"), F.sum("sp").alias("wall"), F.sum("sq").alias("floor_")
        )
        own3 = two.select("u", c("p.c").alias("p"), c("q.c").alias("q"), F.explode("hubs").alias("r"))
        d = own3.select("u", "p", "q", c("r.c").alias("r")).join(hub3, ["p", "q", "r"]).groupBy(
            "u", c("p").alias("v")
        ).agg(F.sum("n3").alias("k23"))
        # Closed 5-walks with one or two hub centres.
        to_hub = pairs.filter("own > 0").select("u", "own", F.explode("hb").alias("h")).groupBy(
            "u", c("h.c").alias("h")
        ).agg(F.sum("own").alias("x"))
        ends = edge.select("u", "v")
        of_v = lists.select(c("u").alias("v"), F.explode(F.transform("hubs", lambda x: x["c"])).alias("h"))
        mixed = ends.join(of_v, "v").join(to_hub, ["u", "h"]).groupBy("u", "v").agg(F.sum("x").alias("w4"))
        back = mixed.select(c("u").alias("v"), c("v").alias("u"), "w4").select("u", "v", "w4")
        of_u = lists.select("u", F.explode(F.transform("hubs", lambda x: x["c"])).alias("p"))
        pure = (
            ends.join(of_u, "u").join(of_v.withColumnRenamed("h", "q"), "v")
            .join(hub2.select("p", "q", "n"), ["p", "q"]).groupBy("u", "v").agg(F.sum("n").alias("w4"))
        )
        return [a, b, d, mixed, back, pure]

    def _clique_sums(self, edge: DataFrame, quads: DataFrame, outs: DataFrame) -> DataFrame:
        c = F.col
        names = ("a", "b", "c", "d")
        rows = F.array(*[
            F.struct(
                F.col(p).alias("u"), F.col(q).alias("v"),
                F.least(*rest).alias("i"), F.greatest(*rest).alias("j"),
            )
            for p in names for q in names if p != q
            for rest in [[r for r in names if r not in (p, q)]]
        ])
        rooted = quads.select(F.explode(rows).alias("r")).select("r.*")
        ij = edge.select(c("u").alias("i"), c("v").alias("j"), c("te").alias("tij"),
                         c("du").alias("di"), c("dv").alias("dj"))
        vi = edge.select(c("u").alias("v"), c("v").alias("i"), c("te").alias("tvi"))
        vj = edge.select(c("u").alias("v"), c("v").alias("j"), c("te").alias("tvj"))
        face = self._clique_triangles(quads).select(
            F.array("i", "j", "k").alias("f"), "kt"
        )
        sums = (
            rooted.join(ij, ["i", "j"]).join(vi, ["v", "i"]).join(vj, ["v", "j"])
            .withColumn("f", F.array_sort(F.array("v", "i", "j")))
            .join(face, "f")
            .groupBy("u", "v")
            .agg(
                F.sum(c("di") + c("dj")).alias("k4d"),
                F.sum(2 * c("tij")).alias("cap_base"),
                F.sum(c("tvi") + c("tvj")).alias("cap_side"),
                F.sum(2 * c("kt")).alias("k5e_side"),
            )
        )
        fives = G.edge_membership(G.clique5_list(quads, outs), ["a", "b", "c", "d", "e"], "n5")
        k5 = G.both_ways(fives, "n5").select("u", "v", (6 * c("n5")).alias("k5"))
        return sums.join(k5, ["u", "v"], "left")

    # -- results ---------------------------------------------------------------------------

    def _combine(self, terms: dict, den: int, name: str) -> Column:
        kind = "decimal(38,0)" if self.wide else "bigint"
        total = " + ".join(f"cast({k} as {kind}) * cast(`{n}` as {kind})" for n, k in terms.items())
        if den == 1:
            return F.expr(f"cast({total} as {kind}) as {name}")
        if self.wide:
            return F.expr(f"cast(round(({total}) / {den}, 0) as {kind}) as {name}")
        return F.expr(f"({total}) div {den} as {name}")

    def edge_orbits(self) -> DataFrame:
        """``edge_id, src, dst, e0..`` with 12 (size 4) or 68 (size 5) counts."""
        _, _, system = _systems(self.size)
        names = [n for n in (SMALL if self.size == 4 else LARGE)]
        sums = (
            self.table.withColumn("x", F.least("u", "v")).withColumn("y", F.greatest("u", "v"))
            .groupBy("x", "y")
            .agg(*[F.sum(n).alias(n) for n in names])
        )
        joined = self.edges.join(sums, ["x", "y"])
        return joined.select(
            "edge_id", F.col("x").alias("src"), F.col("y").alias("dst"),
            *[self._combine(*system[o], f"e{o}") for o in range(patterns.N_EDGE_ORBITS[self.size])],
        )

    def node_orbits(self) -> DataFrame:
        """``v, o0..`` with 15 or 73 counts; isolated nodes get zeros."""
        picked, system, _ = _systems(self.size)
        tail = {o: n for o, (n, end) in picked.items() if end == 0}
        head = {o: n for o, (n, end) in picked.items() if end == 1}
        by_tail = self.table.groupBy(F.col("u").alias("v")).agg(
            *[F.sum(n).alias(str(o)) for o, n in tail.items()]
        )
        by_head = self.table.groupBy("v").agg(*[F.sum(n).alias(str(o)) for o, n in head.items()])
        summed = by_tail.join(by_head, "v")
        out = summed.select(
            "v",
            *[
                self._combine({str(p): k for p, k in terms.items()}, den, f"o{o}")
                for o, (terms, den) in system.items()
            ],
        )
        if self.given_nodes is None:
            return out
        return self.given_nodes.select("v").join(out, "v", "left").fillna(0)


def graphlet_totals(orbits: DataFrame, size: int = 5) -> DataFrame:
    """``graphlet, n`` for graphlets 1..8 or 1..29 from node orbit counts."""
    last = patterns.N_NODE_ORBITS[size]
    first_of: dict[int, tuple[int, int]] = {}
    for o, (g, many) in patterns.orbit_multiplicity().items():
        if 0 < o < last and g not in first_of:
            first_of[g] = (o, many)
    sums = orbits.agg(*[F.sum(f"o{o}").alias(f"g{g}") for g, (o, _) in first_of.items()])
    rows = F.array(*[
        F.struct(
            F.lit(g).alias("graphlet"),
            F.call_function("div", F.col(f"g{g}"), F.lit(many).cast("long")).alias("n"),
        )
        for g, (_, many) in first_of.items()
    ])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def orbit_histogram(orbits: DataFrame, size: int = 5) -> DataFrame:
    """``orbit, n_touching, n_nodes``: how many nodes touch each orbit how often."""
    cols = [f"o{o}" for o in range(patterns.N_NODE_ORBITS[size])]
    return (
        orbits.unpivot(["v"], cols, "orbit", "n_touching")
        .groupBy("orbit", "n_touching")
        .agg(F.count(F.lit(1)).alias("n_nodes"))
    )
