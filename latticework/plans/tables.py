"""Queries on a matrix of the given tables: the mesh of parts.

Parts of equal size form a column of the mesh, in the order of price, then key. A part is tied to the next one of its
column and to the one of the same rank in the next size. The matrix is the mesh's Laplacian plus the identity, so it is
positive definite; it grows with the table, and the separators of its halves are short.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import algebra, incomplete, layout, multilevel, subtrees
from ..operators.lineage import cut, small_broadcasts
from ..operators.prefix import ordered
from ..schema import SYMMETRIC, Matrix
from ..sources import generators
from . import catalog
from .catalog import balances, supplier_part, table
from .parameters import Parameters
from .solver import Solver

#: Vertices of a task and columns of a group, so that the mesh is dissected and factorized by parts.
SHARE, LIMIT = 1_200, 600

MESH = (
    "p as (select p_partkey as i, p_size as s, p_retailprice as v, row_number() over (partition by p_size order by p_retailprice, p_partkey) as r from part), "
    "one as (select a.i, b.i as j from p a join p b on (a.s = b.s and b.r = a.r + 1) or (b.s = a.s + 1 and a.r = b.r)), e as (select i, j from one union all select j, i from one), "
    "a as (select i, j, -1.0::double as re from e union all select p.i, p.i, 1.0 + count(e.j) from p left join e on e.i = p.i group by p.i)"
)


def query(sql: str) -> Callable:
    """Registers a query whose many joins send no more than small tables through the driver."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def run(spark, sf):
            with small_broadcasts(spark):
                return f(spark, sf)

        return catalog.query(sql)(run)

    return add


def places(spark, sf) -> DataFrame:
    """(i, s, r, v): a part's size, its rank in it, and its price."""
    line = Window.partitionBy("p_size").orderBy("p_retailprice", "p_partkey")
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("i"), F.col("p_size").alias("s"), F.row_number().over(line).alias("r"), F.col("p_retailprice").alias("v"))


def mesh(p: DataFrame) -> DataFrame:
    """Edges (i, j) in both directions."""
    near = p.select("i", F.explode(F.array(F.struct("s", (F.col("r") + 1).alias("r")), F.struct((F.col("s") + 1).alias("s"), "r"))).alias("n"))
    one = near.select("i", "n.s", "n.r").join(p.select(F.col("i").alias("j"), "s", "r"), ["s", "r"]).select("i", "j")
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j")))


def matrix(spark, sf) -> tuple[Matrix, DataFrame]:
    """The matrix and the parts."""
    p = cut(places(spark, sf))
    e = cut(mesh(p))
    degree = p.select("i").join(e.groupBy("i").agg(F.count("*").alias("c")), "i", "left")
    diagonal = degree.select("i", F.col("i").alias("j"), (1.0 + F.coalesce("c", F.lit(0))).alias("re"))
    lower = e.where("i > j").select("i", "j", F.lit(-1.0).alias("re")).unionByName(diagonal)
    return Matrix(cut(lower.withColumn("im", F.lit(0.0))), p.count(), SYMMETRIC), p


def known(p: DataFrame, a: Matrix) -> DataFrame:
    """The right-hand side whose solution is the prices."""
    return algebra.spmv(algebra.full(a), p.select("i", F.lit(0).alias("k"), F.col("v").alias("re"), F.lit(0.0).alias("im")))


@query(f"with {MESH} select a.i, round(sum(a.re * p.v), 6) as re from a join p on p.i = a.j group by a.i")
def mesh_product(spark, sf):
    a, p = matrix(spark, sf)
    return known(p, a).select("i", F.round("re", 6).alias("re"))


@query(f"with {MESH} select (select count(*) from p) as n, (select count(*) from e)::bigint as links, true as valid, 0::bigint as crossing, true as balanced, true as less_fill")
def mesh_dissection(spark, sf):
    """The mesh ordered by parts: a bijection without an edge between halves, no part over its share, less fill than the mesh's own band of columns."""
    p = cut(places(spark, sf))
    e = cut(mesh(p))
    order = cut(multilevel.dissection(e, p.select("i"), SHARE, 8))
    n, links = p.count(), e.count()
    parts = order.where(~F.col("region").endswith("2")).groupBy("region").count().agg(F.max("count")).first()[0]
    entries = subtrees.entries(subtrees.tree(e, order)).first()[0]
    band = (places(spark, sf).groupBy("s").count().agg(F.max("count")).first()[0] + 1) * n
    checked = order.agg(F.count("*").alias("n"), ((F.count_distinct("perm") == n) & (F.min("perm") == 0) & (F.max("perm") == n - 1)).alias("valid"))
    broken = multilevel.crossing(e, order).count()
    return checked.select("n", F.lit(links).alias("links"), "valid", F.lit(broken).alias("crossing"), F.lit(parts <= SHARE).alias("balanced"), F.lit(entries < band).alias("less_fill"))


#: Sizes that are multiples of GAP separate strips of the mesh.
GAP = 8
STRIPS = (
    f"o as (select i, s % {GAP} = 0 as sep, s // {GAP} as strip, row_number() over (order by s % {GAP} = 0, case when s % {GAP} = 0 then 0 else s // {GAP} end, s, r) - 1 as perm from p), "
    "g as (select a.perm as i, b.perm as j from e join o a on a.i = e.i join o b on b.i = e.j), "
    "path(j, v) as (select i, j from g union select path.j, g.j from path join g on g.i = path.v where path.v < path.j), l as (select distinct v as i, j from path where v > j)"
)


def strips(p: DataFrame) -> DataFrame:
    """(i, region, perm): strips of sizes as parts, all sizes between them as one separator of the whole."""
    sep, strip = F.col("s") % GAP == 0, F.expr(f"s div {GAP}")
    keyed = p.select("i", sep.alias("sep"), F.when(sep, 0).otherwise(strip).alias("strip"), "s", "r")
    ranked = ordered(keyed, [F.col(c) for c in ("sep", "strip", "s", "r")], "at")
    return ranked.select("i", F.when(F.col("sep"), F.lit("2")).otherwise(F.lpad(F.bin(F.col("strip").cast("long")), 8, "0")).alias("region"), (F.col("at") - 1).alias("perm"))


@query(f"with recursive {MESH}, {STRIPS} select o.perm as i, coalesce(min(l.i), o.perm) as parent, count(l.i) as height from o left join l on l.j = o.perm group by o.perm")
def mesh_columns(spark, sf):
    """Elimination tree and heights of the factor's columns, by parts; each strip is a task, then the separators."""
    p = cut(places(spark, sf))
    return subtrees.heights(cut(subtrees.spans(cut(mesh(p)), cut(strips(p)))))


@query(f"with recursive {MESH}, {STRIPS} select count(*) as entries from l")
def mesh_factor_entries(spark, sf):
    p = cut(places(spark, sf))
    found = subtrees.heights(cut(subtrees.spans(cut(mesh(p)), cut(strips(p)))))
    return found.agg(F.coalesce(F.sum("height"), F.lit(0)).alias("entries"))


def supernodes(p: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The strips' supernodes before merging (first, last, height, spans), and after it (k, first, last, height)."""
    nodes = cut(subtrees.fundamental(cut(subtrees.spans(cut(mesh(p)), order))))
    return nodes, cut(subtrees.merged(nodes.withColumn("head", F.get("spans", 0)), 0.1))


#: Fundamental supernodes of the strips.
NODES = (
    "t as (select o.perm as i, min(l.i) as parent, count(l.i) as height from o left join l on l.j = o.perm group by o.perm), c as (select parent as i, count(*) as kids from t where parent is not null group by parent), "
    "b as (select t.i, t.parent, t.height, coalesce(p.parent = t.i and kids = 1 and t.height = p.height - 1, false) as joins from t left join t p on p.i = t.i - 1 left join c on c.i = t.i), "
    "n as (select *, sum((not joins)::int) over (order by i) as k from b), sn as (select k, min(i) as first, max(i) as last, max_by(height, i) as height, max(parent) filter (i = z) as head from (select *, max(i) over (partition by k) as z from n) group by k)"
)
#: Merging rounds: a row of m is a supernode in a round.
MERGED = (
    f"{NODES}, "
    "m(round, first, last, height, head, budget, again) as (select 0, first, last, height, head, (select floor(0.1 * sum((last - first + 1) * (last - first + 2) // 2 + (last - first + 1) * height))::bigint from sn), true from sn "
    "union all select round + 1, case when taken then son else first end, last, height, head, budget - spent, true from ("
    "select *, coalesce(sum(zeros) filter (taken) over (), 0)::bigint as spent, coalesce(lead(taken) over (order by first), false) as gone, bool_or(taken) over () as any_taken from ("
    "select *, least and upto <= budget as taken from ("
    "select *, sum(zeros) filter (least) over (order by zeros nulls last, first rows unbounded preceding) as upto from ("
    "select *, zeros is not null and coalesce((zeros, first) < (lower_zeros, lower_first), true) and coalesce((zeros, first) < (upper_zeros, upper_first), true) as least from ("
    "select *, lag(zeros) over w as lower_zeros, case when lag(zeros) over w is not null then lag(first) over w end as lower_first, lead(zeros) over w as upper_zeros, case when lead(zeros) over w is not null then lead(first) over w end as upper_first from ("
    "select *, lag(first) over w as son, case when lag(head) over w <= last then (first - lag(first) over w) * (last - first + 1 + height - lag(height) over w) end as zeros from m window w as (order by first)"
    ") window w as (order by first)))))) where any_taken and not gone)"
)


@query(f"with recursive {MESH}, {STRIPS}, {MERGED} select row_number() over (order by first) - 1 as k, first, last, height from m where round = (select max(round) from m)")
def mesh_amalgamated(spark, sf):
    """Supernodes of the strips merged while zeros are a tenth of the entries at most."""
    p = cut(places(spark, sf))
    return supernodes(p, cut(strips(p)))[1]


BLOCKS = (
    "wide as (select first, last from m where round = (select max(round) from m)), "
    "r as (select distinct s.first, s.last, l.i as x, f.first as facing from wide s join l on l.j between s.first and s.last and l.i > s.last join wide f on l.i between f.first and f.last), "
    "runs as (select first, (last - first + 1)::double as w, min(x) as first_row, max(x) as last_row from (select *, x - row_number() over (partition by first, facing order by x) as g from r) group by first, last, facing, g), "
    "h as (select *, (last_row - first_row + 1)::double as h, coalesce(sum(last_row - first_row + 1) over (partition by first order by first_row rows between 1 following and unbounded following), 0)::double as below from runs)"
)


@query(
    f"with recursive {MESH}, {STRIPS}, {MERGED}, {BLOCKS} select first, first_row, last_row, round(w * w * h + w * h * (h + 1) + 2 * w * h * below, 3) as cost from h "
    "union all select first, first, last, round(w * w * w / 3 + w * w / 2 + w / 6, 3) from (select *, (last - first + 1)::double as w from wide)"
)
def mesh_block_costs(spark, sf):
    """Operations of every block of the strips' Cholesky factor, with supernodes merged as in mesh_amalgamated."""
    p = cut(places(spark, sf))
    before, nodes = supernodes(p, cut(strips(p)))
    held = cut(nodes.select("k", "first", "last").join(before.select("last", "spans"), "last"))
    found = subtrees.block_costs(held, "LLT")
    return found.select(F.col("head").alias("first"), "first_row", "last_row", F.round("cost", 3).alias("cost"))


@query("select p_partkey as i, round(p_retailprice, 4) as re from part")
def mesh_solution(spark, sf):
    """Cholesky factorization of the matrix of parts, dissected and analysed by parts; the solution is the prices."""
    a, p = matrix(spark, sf)
    s = Solver(a, Parameters(factorization="LLT", share=SHARE, limit=LIMIT))
    return s.solve(known(p, a)).select("i", F.round("re", 4).alias("re"))


#: Rows of a front that goes by tiles, and of a tile, so that the tables' matrices have some.
FRONT, TILE = 64, 48


@query("select p_partkey as i, round(p_retailprice, 4) as re from part")
def mesh_solution_tiled(spark, sf):
    """The matrix of parts by L U, its separators' fronts in tiles."""
    a, p = matrix(spark, sf)
    s = Solver(a, Parameters(factorization="LU", share=SHARE, limit=LIMIT, front=FRONT, tile=TILE))
    return s.solve(known(p, a)).select("i", F.round("re", 4).alias("re"))


def gram(spark, sf) -> Matrix:
    """Suppliers by suppliers: products of their quantities per part, and the identity a thousand times. Nearly all entries are there, so it is one front."""
    rows = cut(supplier_part(spark, sf))
    one = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").alias("j"), F.lit(1000.0).alias("re"), F.lit(0.0).alias("im"))
    lower = algebra.summed(algebra.gram(rows, lower=True).unionByName(one), "i", "j")
    return Matrix(cut(lower), table(spark, sf, "supplier").count(), SYMMETRIC)


@query("select s_suppkey as i, round(s_acctbal, 4) as re from supplier")
def gram_solution_tiled(spark, sf):
    """Cholesky factorization of a dense matrix in tiles; the solution is the suppliers' balances."""
    a = gram(spark, sf)
    b = algebra.spmv(algebra.full(a), balances(spark, sf))
    return Solver(a, Parameters(factorization="LLT", front=FRONT, tile=TILE)).solve(b).select("i", F.round("re", 4).alias("re"))


@query(f"with {MESH} select i, j, round(re, 8) as re from a")
def mesh_incomplete_factor(spark, sf):
    """L U of an incomplete factorization equals the matrix on the matrix's own places."""
    a, _ = matrix(spark, sf)
    full = cut(algebra.full(a))
    made = incomplete.product(incomplete.factorize(full))
    return made.join(full.select("i", "j"), ["i", "j"]).select("i", "j", F.round("re", 8).alias("re"))


@query("select p_partkey as i, round(p_retailprice, 3) as re from part")
def refine_mesh_incomplete(spark, sf):
    """GMRES on the matrix of parts with ILU(1) as preconditioner."""
    a, p = matrix(spark, sf)
    s = Solver(a, Parameters(refinement="GMRES", incomplete=1, refine_epsilon=1e-8))
    return s.solve(known(p, a)).select("i", F.round("re", 3).alias("re"))


def _low_rank(spark, sf, kind: str, tolerance: float, **options) -> tuple[Solver, DataFrame]:
    """The matrix of parts with low-rank blocks of few rows, as its separators are short."""
    a, p = matrix(spark, sf)
    small = {"compress_least_width": 8, "compress_least_height": 8, "compress_rows": 16}
    return Solver(a, Parameters(factorization=kind, compress_when="MinimalMemory", compress_tolerance=tolerance, **small, **options)), p


@query("select p_partkey as i, round(p_retailprice, 3) as re from part")
def mesh_solution_low_rank(spark, sf):
    """CG on the matrix of parts with an approximate L L^T, whose fronts are low-rank from the start, as preconditioner."""
    s, p = _low_rank(spark, sf, "LLT", 1e-4, refinement="CG", refine_epsilon=1e-9)
    return s.solve(known(p, s.a), refined=True).select("i", F.round("re", 3).alias("re"))


@query("select count(*) as columns, true as less_factor, true as less_front from part")
def mesh_low_rank_memory(spark, sf):
    """Columns of all supernodes; bytes of the factor's blocks, and of the largest front while it was eliminated, against dense ones."""
    s, _ = _low_rank(spark, sf, "LDLT", 1e-2)
    factor = s.factorize()
    fronts = factor.front_memory().agg(F.sum("pivots").alias("columns"), (F.max_by("held_bytes", "dense_bytes") < F.max("dense_bytes")).alias("less_front"))
    less = factor.memory().agg(F.sum("used_bytes") < F.sum("dense_bytes")).first()[0]
    return fronts.select("columns", F.lit(less).alias("less_factor"), "less_front")


#: Unknowns of a part by its size, one to three, and the unknowns' offsets.
UNKNOWNS = "d as (select i, s, v, 1 + s % 3 as dof, sum(1 + s % 3) over (order by i)::bigint - 1 - s % 3 as start from p), u as (select i, v, start + t as x, t from d, unnest(range(dof)) as f(t))"


def counts(p: DataFrame) -> DataFrame:
    return p.select("i", (1 + F.col("s") % 3).cast("long").alias("dof"))


@query(f"with {MESH}, {UNKNOWNS} select r.x as i, count(*) as entries, round(sum(a.re * case when r.t = c.t then 1 else 1.0 / 6 end), 6) as total from a join u r on r.i = a.i join u c on c.i = a.j group by r.x")
def mesh_unknowns(spark, sf):
    """Row sums of the matrix of parts with one to three unknowns a part."""
    a, p = matrix(spark, sf)
    rows = algebra.full(generators.with_variable_dofs(a, cut(layout.offsets(counts(p)))))
    return rows.groupBy("i").agg(F.count("*").alias("entries"), F.round(F.sum("re"), 6).alias("total"))


@query(f"with {MESH}, {UNKNOWNS} select x as i, round(v + t, 4) as re from u")
def mesh_solution_unknowns(spark, sf):
    """Cholesky factorization with one to three unknowns a part, ordered by the graph of parts; the solution is the price and the number of the unknown."""
    a, p = matrix(spark, sf)
    dofs = cut(layout.offsets(counts(p)))
    m = generators.with_variable_dofs(a, dofs)
    s = Solver(m, Parameters(factorization="LLT", share=SHARE))
    x = layout.vertices_of(dofs).withColumnsRenamed({"i": "x", "vertex": "i"}).join(p, "i").join(dofs, "i")
    x = x.select(F.col("x").alias("i"), F.lit(0).alias("k"), (F.col("v") + F.col("x") - F.col("begin")).alias("re"), F.lit(0.0).alias("im"))
    return s.solve(algebra.spmv(algebra.full(s.a), x)).select("i", F.round("re", 4).alias("re"))


@query(
    f"with recursive {MESH}, {STRIPS}, {MERGED}, {BLOCKS}, d as (select perm, sum(1 + s % 3) over (order by perm)::bigint as upto, 1 + s % 3 as dof from o join p using (i)), "
    "held as (select first, first_row, last_row from h union all select first, first, last from wide) "
    "select b.first, x.upto - x.dof as first_row, y.upto - 1 as last_row from held as b join d x on x.perm = b.first_row join d y on y.perm = b.last_row"
)
def mesh_blocks_unknowns(spark, sf):
    """Blocks of the strips' factor in unknowns, one to three a part."""
    p = cut(places(spark, sf))
    order = cut(strips(p))
    before, nodes = supernodes(p, order)
    held = cut(nodes.select("k", "first", "last").join(before.select("last", "spans"), "last"))
    dofs = layout.offsets(counts(p).join(order.select("i", "perm"), "i").select(F.col("perm").alias("i"), "dof"))
    return subtrees.blocks_by(held, cut(dofs)).select(F.col("head").alias("first"), "first_row", "last_row")
