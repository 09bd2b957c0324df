"""Multifrontal factorization and triangular solves over the elimination tree.

The tree is cut: every subtree of at most `limit` columns is one group, eliminated in one task, and the
supernodes above are cut likewise, into groups whose fronts fit in a task together (see grouping). A stage of
groups is one grouped function; what it leaves for later columns comes back as entries that are added
up with those of the matrix (partial sums before the shuffle). So the number of Spark
stages is at most the height of the cut tree, not that of the tree.

With a Compression the rows below a wide enough supernode are cut into blocks, which are kept as U V^T
where that is smaller. JustInTime compresses them after the elimination of a dense front. MinimalMemory never has a dense front: it is
a grid of blocks to which contributions are added in compressed form (see blockfront), and what it leaves is such blocks
up to the group's end. Updates of later columns are products of such blocks. A block's
U and V are entries of a table `panels` (part, stage, grp, node, b, q, at, re, im): b the block's first row,
q the term, at the row or column; a sweep applies V, then U.

A supernode whose front has more than `front` rows is a group of its own and goes by tiles (see tiles), dense whatever the compression; without a Schur complement only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra, blockfront, layout, lowrank, multilevel, ordering, subtrees, symbolic, tiles
from .graph import components, prepare
from .kernels import cut_tree, factor_front
from .lineage import cut
from .prefix import ordered
from ..schema import GENERAL, HERMITIAN, Matrix

KINDS = ("LLT", "LDLT", "LU", "LLH", "LDLH")
#: Machine epsilon of pivot thresholds: relative rounding, half the spacing at 1.
EPSILON = 2.0**-53
#: Edges for each vertex, each counted in both directions, from which on vertices with the same neighbours are looked for.
DENSE = 32
#: Supernodes whose groups one task finds: 32 MB.
NODES = 1_000_000
_PARTS = "part string, k long, i long, j long, b long, re double, im double"


@dataclass(frozen=True)
class Analysis:
    """An ordering, the supernodes (k, first, last, parent, rows) and their groups (k, grp, stage)."""

    n: int
    ordering: DataFrame
    columns: DataFrame
    tree: DataFrame
    groups: DataFrame
    stages: int
    front: int | None = None


@dataclass(frozen=True)
class Factor:
    """lower and upper hold (stage, grp, i, j, re, im), i >= j, diagonals included; d the diagonal of LDL."""

    kind: str
    analysis: Analysis
    lower: DataFrame
    upper: DataFrame
    d: DataFrame | None
    replaced: int
    schur: DataFrame | None = None
    first_schur: int | None = None
    is_complex: bool = False
    panels: DataFrame | None = None
    ranks: DataFrame | None = None
    tiled: tiles.Tiled | None = None
    fronts: DataFrame | None = None

    def memory(self) -> DataFrame:
        """Dense, null and low-rank blocks below supernodes with the bytes that they take."""
        return lowrank.memory(self.ranks, 16 if self.is_complex else 8)

    def front_memory(self) -> DataFrame:
        """Per supernode the rows and pivots of its front, the bytes that it held at most, and those of a dense one."""
        rows = F.col("rows").cast("long")
        return self.fronts.select("node", "rows", "pivots", "held_bytes", (rows * rows * (16 if self.is_complex else 8)).alias("dense_bytes"))


@dataclass(frozen=True)
class Compression:
    """When and how blocks of at most `rows` rows are compressed; narrower supernodes and lower blocks stay dense. tolerance is relative to a block's norm."""

    when: str = "JustInTime"
    method: str = "PQRCP"
    tolerance: float = 1e-8
    least_width: int = 128
    least_height: int = 20
    rows: int = 256

    def of(self, a: np.ndarray) -> lowrank.Block:
        if min(a.shape) == 0 or a.shape[1] < self.least_width or a.shape[0] < self.least_height:
            return lowrank.Block(-1, a, None)
        return lowrank.compress(a, self.tolerance, self.method, relative=True, most=lowrank.rank_limit(*a.shape, self.when))


def low_rank_front(front: np.ndarray, pivots: int, kind: str, criterion: float, c: Compression) -> tuple:
    """As factor_front, with the rows below the pivots as blocks that are compressed after the solve: L of the pivots, D or U of them, blocks (first row, L, U^T or None), what remains, pivots replaced."""
    low, up, _, fixed = factor_front(front[:pivots, :pivots], pivots, kind, criterion)
    hermitian, general = kind in ("LLH", "LDLH"), kind == "LU"
    d = up if kind in ("LDLT", "LDLH") else np.ones(pivots, dtype=front.dtype)
    # a block B of rows becomes B R^-1
    right = up if general else (d[:, None] * (low.conj() if hermitian else low).T)

    def solved(block: np.ndarray, by: np.ndarray) -> lowrank.Block:
        return c.of(np.linalg.solve(by.T, block.T).T)

    m = len(front)
    cuts = [(a, min(a + c.rows, m)) for a in range(pivots, m, c.rows)]
    lower = [solved(front[a:b, :pivots], right) for a, b in cuts]
    upper = [solved(front[:pivots, a:b].T, low.T) for a, b in cuts] if general else [None] * len(cuts)

    def other(n: int) -> lowrank.Block:
        """What L is multiplied with, transposed."""
        if general:
            return upper[n]
        x = lower[n]
        u, v = (x.u.conj(), None if x.v is None else x.v.conj()) if hermitian else (x.u, x.v)
        return lowrank.Block(-1, u * d, None) if x.rank < 0 else lowrank.Block(x.rank, u, d[:, None] * v)

    rest = front[pivots:, pivots:].copy()
    for j, (a, b) in enumerate(cuts):
        by = other(j)
        for i, (e, f) in enumerate(cuts):
            if general or i >= j:
                update = lowrank.multiply(lower[i], by, 0.0).dense()
                rest[e - pivots : f - pivots, a - pivots : b - pivots] -= update
                if not general and i > j:
                    rest[a - pivots : b - pivots, e - pivots : f - pivots] -= (update.conj() if hermitian else update).T
    return low, up, [(a, x, y) for (a, _), x, y in zip(cuts, lower, upper, strict=True)], rest, fixed


def analyze(a: Matrix, order: DataFrame | None = None, limit: int = 20_000, ratio: float = 0.05, last: DataFrame | None = None, leaf: int = 24, share: int = multilevel.SHARE, front: int = tiles.FRONT) -> Analysis:
    """Ordering (nested dissection unless given), elimination tree, supernodes, amalgamation and groups.

    last: vertices (i) to put at the end, as a Schur complement needs; they are in supernodes of their own.
    leaf: vertices that dissection does not cut further. share: a graph of more vertices is dissected and analysed by
    parts; a smaller one goes by its components, each in a task. A graph with many edges goes by classes of vertices with the same neighbours, if they are half as many as these at most. front: rows of a front beyond which it goes by tiles.
    """
    edges = cut(prepare(a.coo))
    vertices = cut(a.coo.sparkSession.range(a.n).select(F.col("id").alias("i")))
    if order is None and last is None and edges.count() > DENSE * a.n:
        classes = indistinguishable(edges, vertices)
        if 2 * classes.select("c").distinct().count() <= a.n:
            return _analyze_classes(a.n, edges, classes, limit, ratio, leaf, share, front)
    if order is None and last is None and a.n > share:
        order = cut(multilevel.dissection(edges, vertices, share, leaf))
        tree = cut(subtrees.tree(edges, order))
        if ratio > 0:
            tree = cut(subtrees.amalgamated(tree, ratio))
        return Analysis(a.n, order.select("i", "perm"), subtrees.columns(tree), tree, *grouping(tree, limit, front), front)
    named = cut(components(edges, vertices))
    if order is None:
        order = ordering.nested_dissection(edges, named, leaf)
    if last is not None:
        listed = order.join(last, "i", "left_semi")
        moved = order.join(last, "i", "left_anti").select("i", "perm", F.lit(0).alias("late")).unionByName(listed.select("i", "perm", F.lit(1).alias("late")))
        order = _renumbered(moved)
    order = cut(order)
    permuted = layout.permute(edges, order)
    labels = layout.apply_order(named, order)
    columns = cut(ordering.elimination(permuted, labels, post=last is None))
    if last is None:
        # after postordering supernodes are runs of columns; components follow each other
        sizes = columns.groupBy("component").agg(F.count("*").alias("c"))
        before = ordered(sizes, [F.col("component")], "at", upto="c").select("component", (F.col("upto") - F.col("c")).alias("before"))
        to = cut(columns.join(before, "component").select("i", (F.col("post") + F.col("before")).alias("q")))
        order = cut(layout.compose(order, to.select("i", F.col("q").alias("perm"))))
        rows = columns.select("i", F.explode("rows").alias("r")).join(to.withColumnRenamed("i", "r"), "r").groupBy("i").agg(F.array_sort(F.collect_list("q")).alias("rows"))
        moved = columns.select("i", "parent").join(rows, "i", "left").join(to.select("i", F.col("q").alias("p")), "i").join(to.select(F.col("i").alias("parent"), F.col("q").alias("up")), "parent")
        columns = cut(moved.select(F.col("p").alias("i"), F.col("up").alias("parent"), F.coalesce("rows", F.array().cast("array<long>")).alias("rows")))
    nodes = cut(ordering.supernodes(columns)) if last is None else columns.select(F.col("i").alias("k"), F.col("i").alias("first"), F.col("i").alias("last"))
    tree = cut(ordering.supernode_tree(nodes, columns))
    if ratio > 0 and last is None:
        nodes = cut(ordering.amalgamated(tree, ratio))
        tree = cut(_widened(nodes, columns))
    if last is not None:
        front = None
    wide = front is not None and tree.where(_front_rows() > front).limit(1).count()
    if a.n <= limit and not wide:  # all of it is one group
        return Analysis(a.n, order, columns, tree, tree.select("k", F.lit(0).cast("long").alias("grp"), F.lit(0).alias("stage")), 1)
    groups, stages = grouping(tree, limit, front)
    return Analysis(a.n, order, columns, tree, groups, stages, front)


def indistinguishable(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(i, c): vertices that have the same neighbours, themselves included, are a class c, its smallest member. edges in both directions, without repetitions. Told by 128 bits of hashes."""
    own = edges.select("i", "j").unionByName(vertices.select("i", F.col("i").alias("j")))
    sign = cut(own.groupBy("i").agg(*(F.bit_xor(F.xxhash64(F.lit(seed), "j")).alias(name) for seed, name in enumerate("ab")), F.count("*").alias("n")), "signs")
    least = sign.groupBy("a", "b", "n").agg(F.min("i").alias("c"))
    return cut(sign.join(least, ["a", "b", "n"]).select("i", "c"), "classes")


def _analyze_classes(n: int, edges: DataFrame, classes: DataFrame, limit: int, ratio: float, leaf: int, share: int, front: int) -> Analysis:
    """Analysis by classes of indistinguishable vertices: the graph of classes is dissected, its supernodes are expanded to their members. The edges of one member stand for all."""
    numbered = cut(ordered(classes, [F.col("c"), F.col("i")], "at").select("i", "c", (F.col("at") - 1).alias("q")), "members")
    dofs = cut(numbered.groupBy(F.col("c").alias("i")).agg(F.min("q").alias("begin"), (F.max("q") + 1).alias("end")), "classes")
    one = edges.select("i", "j").join(dofs.select("i"), "i", "left_semi").join(classes.select(F.col("i").alias("j"), "c"), "j")
    links = cut(one.where("i <> c").select("i", F.col("c").alias("j")).distinct(), "links")
    order = cut(multilevel.dissection(links, dofs.select("i"), share, leaf))
    at = cut(layout.places(order.select("i", "perm"), dofs), "places")
    tree = cut(layout.expand_tree(cut(subtrees.tree(links, order)), at), "supernodes")
    if ratio > 0:
        tree = cut(subtrees.amalgamated(tree, ratio))
    order = cut(numbered.join(layout.unknowns_of(at).withColumnRenamed("i", "q"), "q").select("i", "perm"))
    return Analysis(n, order, subtrees.columns(tree), tree, *grouping(tree, limit, front), front)


def analyze_vertices(n: int, edges: DataFrame, vertices: DataFrame, dofs: DataFrame, limit: int, ratio: float, leaf: int, share: int, front: int) -> Analysis:
    """Analysis of a matrix with several unknowns a vertex, of more than `share` vertices: all of it on the graph of vertices, by parts; then supernodes are expanded.

    vertices (i) and dofs (i, begin, end) are those with unknowns. A vertex's unknowns are taken to be tied to all of its neighbours'.
    """
    order = cut(multilevel.dissection(edges, vertices, share, leaf))
    tree = cut(subtrees.tree(edges, order))
    if ratio > 0:
        tree = cut(subtrees.amalgamated(tree, ratio))
    at = cut(layout.places(order.select("i", "perm"), dofs), "places")
    tree = cut(layout.expand_tree(tree, at), "supernodes")
    return Analysis(n, cut(layout.unknowns_of(at)), subtrees.columns(tree), tree, *grouping(tree, limit, front), front)


def _front_rows():
    return F.col("last") - F.col("first") + 1 + F.size("rows")


def _renumbered(rows: DataFrame) -> DataFrame:
    from .graph import new_numbers

    kept = new_numbers(rows.where("late = 0").select("i", "perm"), "perm")
    n = kept.count()
    late = new_numbers(rows.where("late = 1").select("i", "perm"))
    return kept.select("i", F.col("number").alias("perm")).unionByName(late.select("i", (F.col("number") + n).alias("perm")))


def _widened(nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """The tree of merged supernodes: rows are those of all their columns, beyond the last column."""
    of = nodes.select("k", "first", "last", F.explode(F.sequence("first", "last")).alias("i"))
    rows = of.join(columns, "i").select("k", "last", F.explode_outer("rows").alias("r")).where("r is null or r > last")
    rows = rows.groupBy("k").agg(F.array_sort(F.collect_set("r")).alias("rows"))
    tree = nodes.join(rows, "k", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<long>")))
    up = of.select(F.col("k").alias("parent"), F.col("i").alias("up"))
    # the father holds the first row; a root is its own
    tree = tree.withColumn("up", F.coalesce(F.get("rows", 0), F.col("first")))
    return tree.join(up, "up").select("k", "first", "last", "parent", "rows")


def grouping(tree: DataFrame, limit: int, front: int | None = None) -> tuple[DataFrame, int]:
    """(k, grp, stage) and the number of stages. A node whose front has more than `front` rows is a group of its own.

    Above the subtrees of at most `limit` columns, subtrees of what is left are groups while their fronts have no more entries together than one of `front` rows, in
    as many stages as there are such layers. A tree of more than NODES supernodes is not one task: above the subtrees it goes supernode by supernode, level by level.
    """
    width = F.col("last") - F.col("first") + 1
    if front is not None:  # no subtree with such a node fits under the limit
        width = width + F.when(_front_rows() > front, limit + 1).otherwise(0)
    if tree.count() <= NODES:
        return _in_one_task(tree.select("k", "parent", width.alias("width"), _front_rows().cast("long").alias("rows")), limit, front or tiles.FRONT)
    plain = tree.select(F.col("k").alias("i"), "parent", width.alias("width"))
    size = cut(ordering.subtree_sizes(plain, "width"))
    node = plain.join(size, "i")
    above = size.select(F.col("i").alias("parent"), F.col("size").alias("above"))
    # a subtree that fits under the limit ends where its father's does not
    inner = (F.col("above") <= limit) & (F.col("parent") != F.col("i"))
    now = cut(node.join(above, "parent").select("i", F.when(inner, F.col("parent")).otherwise(F.col("i")).alias("up"), (F.col("size") > limit).alias("top"), "parent"))
    while True:
        further = now.select(F.col("i").alias("up"), F.col("up").alias("next"))
        new = cut(now.join(further, "up").select("i", F.col("next").alias("up"), "top", "parent", (F.col("next") != F.col("up")).alias("moved")))
        if not new.where("moved").limit(1).count():
            break
        now = new.drop("moved")
    depth = ordering.levels(plain.select("i", "parent"))
    deep = new.where("top").join(depth, "i")
    most = deep.agg(F.max("level")).first()[0]
    stages = 1 if most is None else most + 2
    stage = F.when(F.col("top"), F.lit(-1 if most is None else most + 1) - F.col("level")).otherwise(0)
    return cut(new.join(depth, "i").select(F.col("i").alias("k"), F.col("up").alias("grp"), stage.cast("int").alias("stage"))), int(stages)


def _in_one_task(nodes: DataFrame, limit: int, front: int) -> tuple[DataFrame, int]:
    """(k, grp, stage) of nodes (k, parent, width, rows), and the number of stages."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k = pdf["k"].to_numpy()
        rows = pdf["rows"].to_numpy()
        top, stage = cut_tree(np.searchsorted(k, pdf["parent"]).tolist(), pdf["width"].tolist(), (rows * rows).tolist(), limit, front * front)
        return pd.DataFrame({"k": k, "grp": k[top], "stage": stage})

    out = cut(nodes.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "k long, grp long, stage int"))
    return out, int(out.agg(F.coalesce(F.max("stage"), F.lit(0))).first()[0]) + 1


def threshold(a: Matrix, epsilon: float) -> float:
    """Smallest accepted pivot: absolute if epsilon < 0, else a ratio (machine epsilon if 0) of the Frobenius norm."""
    if epsilon < 0:
        return -epsilon
    norm = algebra.norms(algebra.full(a)).first()["norm_fro"] or 0.0
    return (epsilon or EPSILON) * norm


def _eliminate(kind: str, criterion: float, is_complex: bool, schur: int | None, compression: Compression | None = None):
    symmetric = kind != "LU"

    def run(nodes: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("k")
        inside = set(nodes["k"])
        i, j = entries["i"].to_numpy(), entries["j"].to_numpy()
        value = entries["re"].to_numpy() + (1j * entries["im"].to_numpy() if is_complex else 0)
        owner = np.minimum(i, j)
        order = np.argsort(owner, kind="stable")
        i, j, value, owner = i[order], j[order], value[order], owner[order]
        waiting: dict[int, list] = {}
        out, fixed = [], 0

        def put(part: str, k: int, rows, cols, vals, b: int = 0) -> None:
            on = vals != 0
            out.append((part, np.full(on.sum(), k), rows[on], cols[on], vals[on], np.full(on.sum(), b)))

        def put_block(names: str, k: int, rows: np.ndarray, cols: np.ndarray, block: lowrank.Block) -> None:
            """A dense block as entries, another one as those of U (at, q) and V (at, q)."""
            if block.rank < 0:
                r, c = np.meshgrid(rows, cols, indexing="ij")
                put(names[0].upper(), k, r.ravel(), c.ravel(), block.u.ravel())
                return
            q = np.arange(block.rank)
            for side, at, values in (("u", rows, block.u), ("v", cols, block.v)):
                r, c = np.meshgrid(at, q, indexing="ij")
                put(names + side, k, r.ravel(), c.ravel(), values.ravel(), rows[0])

        def put_below(k: int, index: np.ndarray, pivots: int, below: list) -> None:
            """Blocks below the pivots; those of a supernode that is wide enough to be compressed are listed with their rank."""
            for at, x, y in below:
                rows = index[at : at + compression.rows]
                for names, block in (("l", x), ("u", y)):
                    if block is not None:
                        put_block(names, k, rows, index[:pivots], block)
                        if pivots >= compression.least_width:
                            out.append(("R", np.array([k]), np.array([len(rows)]), np.array([pivots]), np.array([float(block.rank)]), np.array([rows[0]])))

        def put_pivots(k: int, rows: np.ndarray, low: np.ndarray, up: np.ndarray) -> None:
            pivots = low.shape[1]
            r, c = np.nonzero(np.tril(np.ones(low.shape, dtype=bool)))
            put("L", k, rows[r], rows[c], low[r, c])
            if kind in ("LDLT", "LDLH"):
                out.append(("D", np.full(pivots, k), rows[:pivots], rows[:pivots], up, np.zeros(pivots, dtype=np.int64)))
            elif kind == "LU":
                put("U", k, rows[r], rows[c], up[c, r])

        def whole(rows: np.ndarray, rest: np.ndarray) -> blockfront.Piece:
            return blockfront.Piece(rows, rows, lowrank.Block(-1, rest, None))

        def give(node, pieces: list[blockfront.Piece]) -> None:
            """To the father if it is in the group, else as entries, a piece at a time."""
            if node.parent in inside:
                waiting.setdefault(node.parent, []).extend(pieces)
            else:
                for piece in pieces:
                    _leave(put, piece, symmetric)

        def in_blocks(node, pivots: int, m: int) -> bool:
            """Whether the front is a grid of blocks: with MinimalMemory all that are wide enough or have more than one run of rows."""
            if compression is None or compression.when != "MinimalMemory" or m == pivots or (schur is not None and node.first >= schur):
                return False
            return pivots >= compression.least_width or m - pivots > compression.rows

        for node in nodes.itertuples(index=False):
            index = np.concatenate([np.arange(node.first, node.last + 1), np.asarray(node.rows, dtype=np.int64)])
            pivots, m = node.last - node.first + 1, len(index)
            dtype = complex if is_complex else float
            lo, hi = np.searchsorted(owner, node.first), np.searchsorted(owner, node.last, "right")
            if in_blocks(node, pivots, m):
                grid = blockfront.Front(index, pivots, kind, compression, dtype)
                grid.enter(i[lo:hi], j[lo:hi], value[lo:hi])
                contributions = waiting.pop(node.k, [])
                while contributions:  # each is dropped once it is added
                    grid.receive(contributions.pop())
                low, up, below, pieces, new = grid.eliminate(criterion)
                put_below(node.k, index, pivots, below)
                put_pivots(node.k, index[:pivots], low, up)
                out.append(("F", np.array([node.k]), np.array([m]), np.array([pivots]), np.array([float(grid.peak)]), np.zeros(1, dtype=np.int64)))
                fixed += new
                give(node, pieces)
                continue
            front = np.zeros((m, m), dtype=dtype)
            np.add.at(front, (np.searchsorted(index, i[lo:hi]), np.searchsorted(index, j[lo:hi])), value[lo:hi])
            for piece in waiting.pop(node.k, ()):
                blockfront.spread(piece, index, front)
            if compression is not None:
                out.append(("F", np.array([node.k]), np.array([m]), np.array([pivots]), np.array([float(front.nbytes)]), np.zeros(1, dtype=np.int64)))
            if schur is not None and node.first >= schur:
                r, c = np.meshgrid(index, index, indexing="ij")
                keep = (r >= c) if symmetric else np.ones_like(r, dtype=bool)
                keep &= np.minimum(r, c) < node.last + 1
                put("S", node.k, r[keep], c[keep], front[keep])
                if m > pivots:
                    give(node, [whole(index[pivots:], front[pivots:, pivots:])])
                continue
            if compression is None or pivots < compression.least_width or m == pivots:
                low, up, rest, new = factor_front(front, pivots, kind, criterion)
            else:
                low, up, below, rest, new = low_rank_front(front, pivots, kind, criterion, compression)
                put_below(node.k, index, pivots, below)
            fixed += new
            put_pivots(node.k, index[: len(low)], low, up)
            if m > pivots:
                give(node, [whole(index[pivots:], rest)])
        if fixed:
            zero = np.zeros(1, dtype=np.int64)
            out.append(("P", zero, zero, zero, np.array([float(fixed)]), zero))
        if not out:
            return pd.DataFrame({"part": [], "k": [], "i": [], "j": [], "b": [], "re": [], "im": []})
        k, i, j, v, b = (np.concatenate([x[c] for x in out]) for c in range(1, 6))
        return pd.DataFrame({"part": np.repeat([x[0] for x in out], [len(x[4]) for x in out]), "k": k, "i": i, "j": j, "b": b, "re": v.real, "im": v.imag})

    return run


def _leave(put, piece: blockfront.Piece, symmetric: bool) -> None:
    block = piece.block.dense()
    r, c = (x.ravel() for x in np.meshgrid(piece.rows, piece.cols, indexing="ij"))
    on = r >= c if symmetric else np.ones(len(r), dtype=bool)
    put("C", -1, r[on], c[on], block.ravel()[on])


def factorize(a: Matrix, analysis: Analysis, kind: str = "LU", epsilon: float = 0.0, schur: int | None = None, compression: Compression | None = None, tile: int = tiles.TILE) -> Factor:
    """Factors of P A P^T, with a compression of low-rank blocks. With schur, columns from that number on are not eliminated and form the Schur complement."""
    if kind not in KINDS:
        raise ValueError(f"no factorization {kind}")
    if kind == "LU" or a.kind == GENERAL:
        entries = layout.permute(algebra.full(a), analysis.ordering)
        if kind != "LU":
            entries = entries.where("i >= j")
    else:  # one triangle moves; what comes to lie above the diagonal is the mirror image
        above, im = F.col("i") < F.col("j"), -F.col("im") if a.kind == HERMITIAN else F.col("im")
        entries = layout.permute(a.coo, analysis.ordering).select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "re", F.when(above, im).otherwise(F.col("im")).alias("im"))
    of = cut(layout.columns_of(analysis.tree).join(analysis.groups, "k").select("j", "grp", "stage"))
    keyed = lambda df: df.join(of.select(F.col("j").alias("owner"), "grp", "stage"), F.least("i", "j") == F.col("owner")).select("grp", "stage", "i", "j", "re", "im")
    pool = cut(keyed(entries))
    nodes = cut(analysis.tree.join(analysis.groups, "k"))
    criterion = threshold(a, epsilon)
    run = _eliminate(kind, criterion, a.is_complex, schur, compression)
    wide = at = None
    steps: dict[int, int] = {}
    if analysis.front is not None and schur is None:
        wide = nodes.where(_front_rows() > analysis.front)
        steps = tiles.steps(wide, tile)
    if steps:
        at = cut(tiles.places(wide, tile))
        nodes = nodes.where(_front_rows() <= analysis.front)
    done, kept = [], []
    for stage in range(analysis.stages):
        here = pool.where(F.col("stage") == stage).groupBy("grp", "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        large = None
        if stage in steps:
            these = wide.where(F.col("stage") == stage)
            its = at.where(F.col("stage") == stage)
            front = tiles.fronts(here.join(these.select("grp"), "grp", "left_semi"), these, its, tile, kind != "LU", a.is_complex)
            here = here.join(these.select("grp"), "grp", "left_anti")
            found, rest, corners = tiles.factorize(front, steps[stage], kind, criterion, a.is_complex, tiles.together(tile))
            kept.append(found.withColumn("stage", F.lit(stage)))
            large = tiles.left_over(rest, corners, its, kind != "LU", a.is_complex)
        made = nodes.where(F.col("stage") == stage).groupBy("grp").cogroup(here.groupBy("grp")).applyInPandas(run, _PARTS)
        made = cut(made if large is None else made.unionByName(large))
        done.append(made)
        if stage + 1 < analysis.stages:
            pool = pool.where(F.col("stage") > stage).unionByName(keyed(made.where("part = 'C'").select("i", "j", "re", "im")))
    everything = done[0]
    for other in done[1:]:
        everything = everything.unionByName(other)
    replaced = everything.where("part = 'P'").agg(F.sum("re")).first()[0] or 0
    tagged = everything.where("part in ('L', 'U')").join(analysis.groups, "k").select("part", "stage", "grp", "i", "j", "re", "im")
    lower = cut(tagged.where("part = 'L'").drop("part"))
    if kind == "LU":
        upper = cut(tagged.where("part = 'U'").drop("part"))
    else:
        upper = lower if kind in ("LLT", "LDLT") else lower.withColumn("im", -F.col("im"))
    d = everything.where("part = 'D'").select("i", "re", "im") if kind in ("LDLT", "LDLH") else None
    s = everything.where("part = 'S'").groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im")) if schur is not None else None
    panels = ranks = fronts = None
    if compression:
        fronts = everything.where("part = 'F'").select(F.col("k").alias("node"), F.col("i").alias("rows"), F.col("j").alias("pivots"), F.col("re").cast("long").alias("held_bytes"))
        panels = everything.where("part in ('lu', 'lv', 'uu', 'uv')").withColumnsRenamed({"i": "at", "j": "q"}).join(analysis.groups, "k")
        panels = cut(panels.select("part", "stage", "grp", F.col("k").alias("node"), "b", "q", "at", "re", "im"))
        ranks = everything.where("part = 'R'").select(F.col("k").alias("node"), "b", F.col("i").cast("int").alias("m"), F.col("j").cast("int").alias("n"), F.col("re").cast("int").alias("rank"))
    tiled = tiles.Tiled(tiles.union(kept), at, steps, tiles.together(tile)) if steps else None
    return Factor(kind, analysis, lower, upper, d, int(replaced), s, schur, a.is_complex, panels, ranks, tiled, fronts)


def _sweep(is_complex: bool, back: bool):
    """Solves the columns of a group: forward, or backward with the transpose."""

    def run(entries: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        rows_of_panels = entries[entries["part"] != ""]
        entries = entries[entries["part"] == ""]
        i, j = entries["i"].to_numpy(), entries["j"].to_numpy()
        v = entries["re"].to_numpy() + (1j * entries["im"].to_numpy() if is_complex else 0)
        cols = np.unique(j)
        index = np.union1d(np.union1d(cols, i), rows_of_panels["i"].to_numpy())
        ks = np.unique(rhs["k"].to_numpy())
        x = np.zeros((len(index), len(ks)), dtype=complex if is_complex else float)
        own = np.isin(rhs["i"].to_numpy(), index)
        np.add.at(x, (np.searchsorted(index, rhs["i"].to_numpy()[own]), np.searchsorted(ks, rhs["k"].to_numpy()[own])), (rhs["re"].to_numpy() + (1j * rhs["im"].to_numpy() if is_complex else 0))[own])
        order = np.lexsort((i, j))
        i, j, v = np.searchsorted(index, i[order]), j[order], v[order]
        at = np.append(np.searchsorted(j, cols), len(j))
        # a block takes effect once its last column is solved, or before that one is in the other direction
        panels: dict[int, list] = {}
        for _, block in rows_of_panels.groupby(["node", "b"]):
            rank, sides = int(block["j"].max()) + 1, {}
            for side, part in block.groupby(block["part"].str[1]):
                places = np.unique(part["i"].to_numpy())
                values = np.zeros((len(places), rank), dtype=x.dtype)
                values[np.searchsorted(places, part["i"].to_numpy()), part["j"].to_numpy()] = part["re"].to_numpy() + (1j * part["im"].to_numpy() if is_complex else 0)
                sides[side] = np.searchsorted(index, places), values
            if len(sides) == 2:
                panels.setdefault(int(sides["v"][0][-1]), []).append((*sides["u"], *sides["v"]))
        for c in range(len(cols) - 1, -1, -1) if back else range(len(cols)):
            s, e = at[c], at[c + 1]
            if back:
                for rows, u, columns, w in panels.get(i[s], ()):
                    x[columns] -= w @ (u.T @ x[rows])
                x[i[s]] = (x[i[s]] - v[s + 1 : e] @ x[i[s + 1 : e]]) / v[s]
            else:
                x[i[s]] /= v[s]
                x[i[s + 1 : e]] -= np.outer(v[s + 1 : e], x[i[s]])
                for rows, u, columns, w in panels.get(i[s], ()):
                    x[rows] -= u @ (w.T @ x[columns])
        local = np.isin(index, cols)
        give = np.flatnonzero(local if back else np.ones(len(index), dtype=bool))
        r, k = np.meshgrid(give, np.arange(len(ks)), indexing="ij")
        r, k = r.ravel(), k.ravel()
        out = x[r, k]
        return pd.DataFrame({"own": local[r], "i": index[r], "k": ks[k], "re": out.real, "im": out.imag})

    return run


def triangular(entries: DataFrame, b: DataFrame, analysis: Analysis, back: bool, is_complex: bool, stop: int | None = None, panels: DataFrame | None = None, tiled: tuple[tiles.Tiled, str, bool] | None = None) -> DataFrame:
    """x with T x = b, T of entries (stage, grp, i, j, re, im), panels and tiles (with their side and whether conjugate) forward, or its transpose backward. stop: columns from there on pass through."""
    of = layout.columns_of(analysis.tree).join(analysis.groups, "k").select(F.col("j").alias("i"), "grp", "stage")
    rest = cut(b.join(of, "i"))
    solved = rest.where(F.col("i") >= stop).select("i", "k", "re", "im") if stop is not None else None
    if stop is not None and not back:
        late, rest, solved = solved, rest.where(F.col("i") < stop), None
    elif stop is not None:
        rest = rest.where(F.col("i") < stop)
    run = _sweep(is_complex, back)
    for stage in reversed(range(analysis.stages)) if back else range(analysis.stages):
        here = entries.where(F.col("stage") == stage)
        low = None if panels is None else panels.where(F.col("stage") == stage)
        rhs = rest.where(F.col("stage") == stage)
        large = below = None
        if tiled and stage in tiled[0].steps:
            f, side, conjugate = tiled
            wide = f.tiles.where(F.col("stage") == stage).select("grp").distinct()
            known = solved if solved is not None else b.select("i", "k", "re", "im").limit(0)
            large, below = tiles.solve(f, stage, side, rhs.join(wide, "grp", "left_semi").select("i", "k", "re", "im"), back, is_complex, conjugate, known)
            rhs = rhs.join(wide, "grp", "left_anti")
        if back and solved is not None:
            outer = here.join(solved.select("i", "k", F.col("re").alias("x_re"), F.col("im").alias("x_im")), "i")
            re, im = algebra.times(F.col("re"), F.col("im"), F.col("x_re"), F.col("x_im"))
            outer = outer.groupBy("grp", F.col("j").alias("i"), "k").agg((-F.sum(re)).alias("re"), (-F.sum(im)).alias("im"))
            if low is not None:
                # V (U^T x) of the rows that are solved already
                term, place = ["grp", "node", "b", "q"], F.col("at") == F.col("i")
                u = low.where("part like '_u'").join(solved.select("i", "k", F.col("re").alias("x_re"), F.col("im").alias("x_im")), place)
                re, im = algebra.times(F.col("re"), F.col("im"), F.col("x_re"), F.col("x_im"))
                t = u.groupBy(*term, "k").agg(F.sum(re).alias("x_re"), F.sum(im).alias("x_im"))
                v = low.where("part like '_v'").select(*term, "at", "re", "im").join(t, term)
                re, im = algebra.times(F.col("re"), F.col("im"), F.col("x_re"), F.col("x_im"))
                outer = outer.unionByName(v.groupBy("grp", F.col("at").alias("i"), "k").agg((-F.sum(re)).alias("re"), (-F.sum(im)).alias("im")))
            rhs = rhs.select("grp", "i", "k", "re", "im").unionByName(outer).groupBy("grp", "i", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        none = F.lit(0).cast("long")
        here = here.select("grp", F.lit("").alias("part"), none.alias("node"), none.alias("b"), "i", "j", "re", "im")
        if low is not None:
            here = here.unionByName(low.select("grp", "part", "node", "b", F.col("at").alias("i"), F.col("q").alias("j"), "re", "im"))
        made = cut(here.groupBy("grp").cogroup(rhs.groupBy("grp")).applyInPandas(run, "own boolean, i long, k int, re double, im double"))
        new = made.where("own").select("i", "k", "re", "im")
        if large is not None:
            new = new.unionByName(cut(large))
        solved = new if solved is None else solved.unionByName(new)
        if not back:
            moved = made.where("not own").select("i", "k", "re", "im")
            if below is not None:
                moved = moved.unionByName(cut(below))
            if stop is not None:
                late = late.unionByName(moved.where(F.col("i") >= stop))
            rest = rest.where(F.col("stage") > stage).unionByName(moved.join(of, "i").select(rest.columns))
    if stop is not None and not back:
        solved = solved.unionByName(late)
    return algebra.summed(solved, "i", "k")


def solve(f: Factor, b: DataFrame, trans: str = algebra.NO, mode: str = "Local") -> DataFrame:
    """x with op(A) x = b. With a Schur complement: `Interface` stops after the forward sweep, `Backward` starts from its values."""
    is_complex = f.is_complex
    if trans == algebra.CONJ and f.kind in ("LLT", "LDLT", "LU") and is_complex:
        b = b.withColumn("im", -F.col("im"))
    y = layout.apply_order(b, f.analysis.ordering)
    swapped = trans != algebra.NO and f.kind == "LU" or trans == algebra.TRANS and f.kind in ("LLH", "LDLH") and is_complex
    down, up = (f.upper, f.lower) if swapped else (f.lower, f.upper)
    down_panels = up_panels = None
    if f.panels is not None:
        of_lower, of_upper = (f.panels.where(f"part like '{x}_'") for x in "lu")
        if f.kind != "LU":
            of_upper = of_lower if f.kind in ("LLT", "LDLT") else of_lower.withColumn("im", -F.col("im"))
        down_panels, up_panels = (of_upper, of_lower) if swapped else (of_lower, of_upper)
    down_tiles = up_tiles = None
    if f.tiled is not None:
        of_lower, of_upper = (f.tiled, "low", False), (f.tiled, "up" if f.kind == "LU" else "low", f.kind in ("LLH", "LDLH"))
        down_tiles, up_tiles = (of_upper, of_lower) if swapped else (of_lower, of_upper)
    if mode != "Backward":
        y = triangular(down, y, f.analysis, False, is_complex, f.first_schur, down_panels, down_tiles)
        if f.d is not None:
            scaled = algebra.scale_rows(y, f.d, divide=True)
            y = scaled if f.first_schur is None else scaled.unionByName(y.where(F.col("i") >= f.first_schur))
    if mode != "Interface":
        y = triangular(up, y, f.analysis, True, is_complex, f.first_schur, up_panels, up_tiles)
    x = layout.apply_order(y, f.analysis.ordering, back=True)
    if trans == algebra.CONJ and f.kind in ("LLT", "LDLT", "LU") and is_complex:
        x = x.withColumn("im", -F.col("im"))
    return cut(x)


def schur_complement(f: Factor) -> DataFrame:
    """The Schur complement's entries (i, j from 0, in the order of the listed unknowns); both triangles."""
    s = f.schur.select((F.col("i") - f.first_schur).alias("i"), (F.col("j") - f.first_schur).alias("j"), "re", "im")
    if f.kind == "LU":
        return s
    return s.unionByName(algebra.transpose(s.where("i <> j"), f.kind in ("LLH", "LDLH")))


def statistics(analysis: Analysis, kind: str) -> dict:
    """Entries of the factor and operations."""
    blok = symbolic.blocks(analysis.tree)
    h = cut(symbolic.heights(blok))
    return {"nnz": symbolic.factor_entries(h).first()[0], "flops": symbolic.total_flops(h, kind).first()[0]}


def default_kind(a: Matrix, definite: bool = False) -> str:
    if a.kind == GENERAL:
        return "LU"
    if a.kind == HERMITIAN:
        return "LLH" if definite else "LDLH"
    return "LLT" if definite else "LDLT"
