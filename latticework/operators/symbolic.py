"""Block structure of factors, incomplete levels, statistics, cost models and splitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .lineage import cut
from .prefix import ordered


def column_structure(columns: DataFrame) -> DataFrame:
    """Entries (i, j) of the factor strictly below the diagonal, from (i, parent, rows)."""
    return columns.select(F.col("i").alias("j"), F.explode("rows").alias("i"))


def united_columns(pattern: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows (k, i) of each supernode: the union of its columns' patterns, from (i, j) and each column's supernode (j, k)."""
    return pattern.join(columns, "j").select("k", "i").distinct()


def fill_pattern(edges: DataFrame) -> DataFrame:
    """The same entries by elimination rounds on DataFrames: child structures join their fathers level by level.

    edges (i, j), both directions, in elimination order.
    """
    have = cut(edges.where("i > j").select("i", "j").distinct())
    new = have
    while True:
        # the father of a column is its first row; what is below it belongs to the father's column, too
        father = have.groupBy("j").agg(F.min("i").alias("f"))
        moved = new.join(father, "j").where("i > f").select("i", F.col("f").alias("j")).distinct()
        fresh = cut(moved.join(have, ["i", "j"], "left_anti"))
        if not fresh.limit(1).count():
            return have
        # a father may change when its column gets a smaller first row: all entries move again
        have = cut(have.unionByName(fresh))
        new = have


def incomplete_levels(edges: DataFrame, most: int) -> DataFrame:
    """Level of fill of each entry (i, j, level) of an ILU(k) pattern, level <= most.

    lvl(i, j) = min over p < min(i, j) of lvl(i, p) + lvl(p, j) + 1; rounds of joins until nothing changes.
    True breadth-first levels: a path through eliminated vertices of most + 1 edges at most.
    """
    have = cut(edges.where("i <> j").select("i", "j", F.lit(0).alias("level")).distinct())
    for _ in range(most):
        left = have.where("j < i").select("i", F.col("j").alias("p"), F.col("level").alias("a"))
        right = have.where("i < j").select(F.col("i").alias("p"), "j", F.col("level").alias("b"))
        new = left.join(right, "p").where("i <> j").select("i", "j", (F.col("a") + F.col("b") + 1).alias("level")).where(F.col("level") <= most)
        have = cut(have.unionByName(new).groupBy("i", "j").agg(F.min("level").alias("level")))
    return have


def blocks(tree: DataFrame) -> DataFrame:
    """Blocks of the factor: (k, first_row, last_row, facing), the diagonal block of each supernode first.

    Rows below a supernode (k, first, last, parent, rows) are cut into runs of consecutive rows that
    lie in one supernode.
    """
    rows = tree.select("k", F.explode("rows").alias("r"))
    of = tree.select(F.col("k").alias("facing"), F.explode(F.sequence("first", "last")).alias("r"))
    w = Window.partitionBy("k", "facing").orderBy("r")
    runs = rows.join(of, "r").withColumn("run", F.col("r") - F.row_number().over(w))
    off = runs.groupBy("k", "facing", "run").agg(F.min("r").alias("first_row"), F.max("r").alias("last_row"))
    own = tree.select("k", F.col("first").alias("first_row"), F.col("last").alias("last_row"), F.col("k").alias("facing"))
    return own.unionByName(off.select("k", "first_row", "last_row", "facing"))


def facing_lists(blok: DataFrame) -> DataFrame:
    """Per supernode the blocks of other supernodes that face it."""
    return blok.where("k <> facing").groupBy("facing").agg(F.array_sort(F.collect_list(F.struct("k", "first_row"))).alias("blocks"))


def find_facing(blok: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks of supernode `facing` that contain a row range: an equi-join on facing with a range condition."""
    b = blok.select(F.col("k").alias("facing"), F.col("first_row").alias("b_first"), F.col("last_row").alias("b_last"))
    return ranges.join(b, "facing").where("first_row >= b_first and last_row <= b_last")


def check_blocks(blok: DataFrame) -> DataFrame:
    """Numbers of violations: empty ranges, blocks that face an earlier supernode, supernodes without a diagonal block."""
    per = blok.groupBy("k").agg(
        F.sum((F.col("last_row") < F.col("first_row")).cast("long")).alias("empty"), F.sum((F.col("facing") < F.col("k")).cast("long")).alias("back"), F.max((F.col("k") == F.col("facing")).cast("long")).alias("own")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(total(F.col("empty")).alias("empty_ranges"), total(F.col("back")).alias("backward"), total(1 - F.col("own")).alias("no_diagonal"))


def heights(blok: DataFrame) -> DataFrame:
    """Per supernode its width and the number of rows below."""
    rows = F.col("last_row") - F.col("first_row") + 1
    return blok.groupBy("k").agg(F.sum(F.when(F.col("k") == F.col("facing"), rows).otherwise(0)).alias("width"), F.sum(F.when(F.col("k") != F.col("facing"), rows).otherwise(0)).alias("below"), F.count("*").alias("bloks"))


def statistics(blok: DataFrame) -> DataFrame:
    h = heights(blok)
    return h.agg(F.count("*").alias("cblks"), F.sum("bloks").alias("bloks"), F.avg("width").alias("avg_width"), F.max("width").alias("max_width"), F.avg("below").alias("avg_below"), F.max("below").alias("max_below"))


def factor_entries(h: DataFrame) -> DataFrame:
    """Entries strictly below the diagonal."""
    w, r = F.col("width"), F.col("below")
    return h.agg(F.sum(F.floor(w * (w + 1) / 2) - w + r * w).cast("long").alias("nnz"))


def flops(kind: str, w: Column, r: Column, complex_: bool = False) -> Column:
    """Operations of a panel of w columns with r rows below: its factorization, the solve below and the updates."""
    mul, add = (6.0, 2.0) if complex_ else (1.0, 1.0)
    w, r = w.cast("double"), r.cast("double")
    if kind == "LU":
        diag_mul = w * w * w / 3 - w / 3
        diag_add = w * w * w / 3 - w * w / 2 + w / 6
        solve = 2 * r * w * w / 2
        update = w * r * r
        return (diag_mul + solve + r * w + update) * mul + (diag_add + solve - r * w + update) * add
    diag_mul = w * w * w / 6 + w * w / 2 + w / 3 if kind in ("LLT", "LLH") else w * w * w / 6 + w * w - w * 7 / 6
    diag_add = w * w * w / 6 - w / 6
    solve = r * w * w / 2
    update = w * r * (r + 1) / 2
    return (diag_mul + solve + r * w / 2 + update) * mul + (diag_add + solve - r * w / 2 + update) * add


def total_flops(h: DataFrame, kind: str, complex_: bool = False) -> DataFrame:
    return h.agg(F.sum(flops(kind, F.col("width"), F.col("below"), complex_)).alias("flops"))


def time_model(m: Column, n: Column, k: Column, coefficients: tuple = (2.429169e-10, 1e-9, 1e-9, 1e-7)) -> Column:
    """Seconds of an m x n x k product by a polynomial model: cubic, two quadratic and a constant coefficient."""
    cubic, mk, nk, base = coefficients
    m, n, k = m.cast("double"), n.cast("double"), k.cast("double")
    return cubic * m * n * k + mk * m * k + nk * n * k + base


def costs(blok: DataFrame, kind: str) -> DataFrame:
    """Cost of each supernode (k, cost) in flops."""
    return heights(blok).select("k", flops(kind, F.col("width"), F.col("below")).alias("cost"))


def block_cost(kind: str, w: Column, h: Column, below: Column, complex_: bool = False) -> Column:
    """Flops of a block of h rows below a diagonal block of w columns, with `below` rows under it in the panel: the solve, and its products with itself and the blocks under it."""
    mul, add = (6.0, 2.0) if complex_ else (1.0, 1.0)
    w, h, below = w.cast("double"), h.cast("double"), below.cast("double")
    general = kind == "LU"
    solve, divide = (h * w * w, h * w) if general else (h * w * w / 2, h * w / 2)
    pairs = h * h + 2 * h * below if general else h * (h + 1) / 2 + h * below
    return (solve + divide + w * pairs) * mul + (solve - divide + w * pairs) * add


def block_costs(blok: DataFrame, kind: str, complex_: bool = False) -> DataFrame:
    """Flops of each block (k, first_row, last_row, facing, cost): a diagonal block's factorization; of another one the solve with it and its products with itself and all blocks below it in the panel.

    They add up to `costs` of the supernode. A panel's blocks are one window, of as many rows as it has blocks.
    """
    own, rows = F.col("k") == F.col("facing"), F.col("last_row") - F.col("first_row") + 1
    panel = Window.partitionBy("k").orderBy("first_row")
    sized = blok.withColumn("h", rows.cast("double")).withColumn("w", F.first("h").over(panel))
    sized = sized.withColumn("below", F.coalesce(F.sum("h").over(panel.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    w, h, below = F.col("w"), F.col("h"), F.col("below")
    cost = F.when(own, flops(kind, w, F.lit(0), complex_)).otherwise(block_cost(kind, w, h, below, complex_))
    return sized.select("k", "first_row", "last_row", "facing", cost.alias("cost"))


def split_constant(nodes: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Supernodes cut into pieces of at most about `most` columns: (k, piece, first, last).

    The number of pieces is ceil(width / most), one less if pieces would fall below `least`.
    """
    width = F.col("last") - F.col("first") + 1
    count = F.ceil(width / most)
    count = F.greatest(F.lit(1), F.when((count > 1) & (F.floor(width / count) < least), count - 1).otherwise(count))
    out = nodes.withColumn("width", width).withColumn("count", count).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    at = lambda p: F.col("first") + F.floor(p * F.col("width") / F.col("count"))
    return out.select("k", "piece", at(F.col("piece")).alias("first"), (at(F.col("piece") + 1) - 1).alias("last"))


def split_blocks(blok: DataFrame, pieces: DataFrame) -> DataFrame:
    """Blocks of a structure whose supernodes are cut: both the columns and the facing rows follow the pieces."""
    cols = pieces.select("k", "piece", F.col("first").alias("c_first"), F.col("last").alias("c_last"))
    rows = pieces.select(F.col("k").alias("facing"), F.col("piece").alias("facing_piece"), F.col("first").alias("f_first"), F.col("last").alias("f_last"))
    out = blok.join(cols, "k").join(rows, "facing").where("first_row <= f_last and last_row >= f_first")
    out = out.where("k <> facing or facing_piece >= piece")
    return out.select("k", "piece", "facing", "facing_piece", F.greatest("first_row", "f_first").alias("first_row"), F.least("last_row", "f_last").alias("last_row"))


def expand_blocks(blok: DataFrame, dof: int) -> DataFrame:
    """Blocks of the unknowns, dof of them for each vertex."""
    return blok.select("k", (F.col("first_row") * dof).alias("first_row"), ((F.col("last_row") + 1) * dof - 1).alias("last_row"), "facing")


def expand_blocks_by(blok: DataFrame, dofs: DataFrame) -> DataFrame:
    """Blocks of the unknowns of vertices with different numbers of them; dofs (i, begin, end) by the vertices' places in the order. Rows of a vertex without unknowns vanish."""
    begin = dofs.select(F.col("i").alias("first_row"), "begin")
    end = dofs.select(F.col("i").alias("last_row"), "end")
    out = blok.join(begin, "first_row").join(end, "last_row").where("end > begin")
    return out.select("k", F.col("begin").alias("first_row"), (F.col("end") - 1).alias("last_row"), "facing")


def candidates(tree: DataFrame, least_width: int) -> DataFrame:
    """(k, eligible): a supernode stays eligible while it and all its ancestors are at least so wide."""
    ok = (F.col("last") - F.col("first") + 1) >= least_width
    now = cut(tree.select("k", F.when(F.col("k") != F.col("parent"), F.col("parent")).alias("up"), ok.alias("eligible")))
    while now.where("up is not null").limit(1).count():
        above = now.select(F.col("k").alias("up"), F.col("up").alias("next"), F.col("eligible").alias("more"))
        now = cut(now.join(above, "up", "left").select("k", F.col("next").alias("up"), (F.col("eligible") & F.coalesce("more", F.lit(True))).alias("eligible")))
    return now.select("k", "eligible")


def proportional_map(cost: DataFrame, bins: int) -> DataFrame:
    """(k, bin): supernodes in postorder dealt to bins of about equal cost by prefix sums."""
    total = F.lit(cost.agg(F.sum("cost")).first()[0])
    middle = F.col("upto") - F.col("cost") / 2
    return ordered(cost, [F.col("k")], "at", upto="cost").select("k", F.least(F.lit(bins - 1), F.floor(middle * bins / total)).cast("int").alias("bin"))


def hamming(sets: DataFrame, stop: int = 1 << 30) -> DataFrame:
    """Distance of neighbouring rows (k, r, contributors): size of the symmetric difference, at most stop."""
    w = Window.partitionBy("k").orderBy("r")
    before = F.lag("contributors").over(w)
    d = F.size(F.array_except("contributors", before)) + F.size(F.array_except(before, F.col("contributors")))
    return sets.select("k", "r", F.when(before.isNotNull(), F.least(d, F.lit(stop))).alias("distance"))


def contributors(blok: DataFrame) -> DataFrame:
    """Per row r of a supernode k the sorted set of supernodes that have a block on it."""
    rows = blok.where("k <> facing").select(F.col("k").alias("c"), F.col("facing").alias("k"), F.explode(F.sequence("first_row", "last_row")).alias("r"))
    return rows.groupBy("k", "r").agg(F.array_sort(F.collect_set("c")).alias("contributors"))


def reordered(sets: DataFrame, nodes: DataFrame, stop: int = 1 << 30) -> DataFrame:
    """Rows of each supernode in a new order that joins blocks: (k, r, position)."""
    rows = nodes.select("k", F.explode(F.sequence("first", "last")).alias("r")).join(sets, ["k", "r"], "left")

    def tour(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r").reset_index(drop=True)
        order = kernels.hamming_order([frozenset() if c is None else frozenset(c) for c in pdf["contributors"]], stop)
        out = pdf.iloc[order][["k", "r"]].copy()
        out["position"] = range(len(out))
        return out

    return rows.groupBy("k").applyInPandas(tour, "k long, r long, position int")
