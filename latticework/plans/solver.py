"""The solver object: analyse once, factorise, solve and refine as often as wanted."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import algebra, graph, incomplete, layout, multilevel, numeric, ordering, refine, tiles
from ..operators.lineage import cut, small_broadcasts
from ..schema import Matrix
from .parameters import Parameters


#: The tasks of a run, in their order.
TASKS = ("Init", "Ordering", "Symbolic", "Analyze", "Factorize", "Solve", "Refine", "Clean")


def _small(step: Callable) -> Callable:
    """A step whose many joins send no more than small tables through the driver."""

    @wraps(step)
    def run(self, *args, **options):
        with small_broadcasts(self.a.coo.sparkSession):
            return step(self, *args, **options)

    return run


class Solver:
    """Solves A x = b. Steps run when they are first needed and again after what they depend on changes.

    definite: a symmetric or Hermitian matrix is positive definite. order: a permutation (i, perm) of one's
    own, which the orderings Grid (see ordering.grid) and Personal need. schur: unknowns (i) whose Schur complement is wanted instead of a complete factor.
    isolate: unknowns (i) that are eliminated last, such as those with a diagonal near zero.
    """

    def __init__(self, a: Matrix, parameters: Parameters | None = None, definite: bool = False, order: DataFrame | None = None, schur: DataFrame | None = None, isolate: DataFrame | None = None):
        self.parameters = parameters or Parameters()
        if order is None and self.parameters.ordering in ("Grid", "Personal"):
            raise ValueError(f"ordering={self.parameters.ordering} needs an order")
        self.kind = self.parameters.factorization or numeric.default_kind(a, definite)
        if schur is not None and isolate is not None:
            raise ValueError("unknowns are either isolated or those of a Schur complement")
        self.order, self.listed, self.isolated = order, schur, isolate
        self.x: DataFrame | None = None
        self.analysis: numeric.Analysis | None = None
        self.factor: numeric.Factor | None = None
        self.log: refine.Result | None = None
        self.setup(a)

    def setup(self, a: Matrix) -> None:
        """Another matrix: all steps are undone."""
        self.a = Matrix(cut(a.coo), a.n, a.kind, a.arithmetic, a.dof, None if a.dofs is None else cut(a.dofs))
        self.analysis = self.factor = None

    @_small
    def analyze(self) -> numeric.Analysis:
        if self.analysis is None:
            order = self.order
            if order is None and self.parameters.ordering == "Identity":
                order = self.a.coo.sparkSession.range(self.a.n).select(F.col("id").alias("i"), F.col("id").alias("perm"))
            if order is None and (self.a.dof > 1 or self.a.dofs is not None):
                p, found = self.parameters, self._vertex_graph()
                edges, vertices, dofs = found
                if self.listed is None and self.isolated is None and vertices.count() > p.share:
                    self.analysis = numeric.analyze_vertices(self.a.n, edges, vertices, dofs, p.limit, p.amalgamation, p.leaf, p.share, p.front)
                    return self.analysis
                order = self._vertex_order(found)
            self.analysis = numeric.analyze(self.a, order, self.parameters.limit, self.parameters.amalgamation, self.isolated if self.listed is None else self.listed, self.parameters.leaf, self.parameters.share, self.parameters.front)
        return self.analysis

    def _vertex_graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Edges (i, j) in both directions and vertices (i) of the graph of vertices with unknowns, and their unknowns (i, begin, end)."""
        dof, spark = self.a.dof, self.a.coo.sparkSession
        if self.a.dofs is None:
            vertex = lambda c: F.floor(F.col(c) / dof).alias(c)
            pairs = self.a.coo.select(vertex("i"), vertex("j"))
            vertices = spark.range(self.a.n // dof).select(F.col("id").alias("i"))
            dofs = layout.constant_dofs(vertices, dof)
        else:
            dofs = self.a.dofs.where("end > begin")
            of = layout.vertices_of(dofs)
            rows, cols = of.withColumnRenamed("vertex", "row"), of.select(F.col("i").alias("j"), F.col("vertex").alias("col"))
            pairs = self.a.coo.select("i", "j").join(rows, "i").join(cols, "j").select(F.col("row").alias("i"), F.col("col").alias("j"))
            vertices = dofs.select("i")
        return cut(graph.prepare(pairs)), cut(vertices), dofs

    def _vertex_order(self, found: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
        """The ordering of the graph of vertices (that found by _vertex_graph), its places expanded to their unknowns."""
        (edges, vertices, dofs), p = found or self._vertex_graph(), self.parameters
        if vertices.count() > p.share:
            order = multilevel.dissection(edges, vertices, p.share, p.leaf).select("i", "perm")
        else:
            order = ordering.nested_dissection(edges, cut(graph.components(edges, vertices)), p.leaf)
        return layout.expand_ordering(order, dofs)

    @_small
    def factorize(self) -> numeric.Factor:
        if self.factor is None:
            first = None if self.listed is None else self.a.n - self.listed.count()
            p = self.parameters
            compression = None if p.compress_when == "Never" else numeric.Compression(p.compress_when, p.compress_method, p.compress_tolerance, p.compress_least_width, p.compress_least_height, p.compress_rows)
            self.factor = numeric.factorize(self.a, self.analyze(), self.kind, p.epsilon, first, compression, p.tile)
            if self.parameters.mixed:
                single = lambda df: None if df is None else cut(algebra.to_single(df))
                f = self.factor
                self.factor = replace(f, lower=single(f.lower), upper=single(f.upper), d=single(f.d), panels=single(f.panels))
        return self.factor

    @_small
    def solve(self, b: DataFrame, refined: bool = False, trans: str | None = None) -> DataFrame:
        """x (i, k, re, im)."""
        trans = trans or self.parameters.trans
        if self.parameters.incomplete >= 0:  # there is no complete factor to solve with
            return self.refine(b, None, trans)
        x = numeric.solve(self.factorize(), b, trans)
        return self.refine(b, x, trans) if refined else x

    @_small
    def refine(self, b: DataFrame, x: DataFrame | None = None, trans: str | None = None, preconditioned: bool = True) -> DataFrame:
        """Iterative refinement of each right-hand side by the chosen method."""
        p = self.parameters
        trans = trans or p.trans
        if self.listed is not None:
            raise ValueError("with a Schur complement there is no factor of all unknowns to refine with")
        a = refine.matvec(cut(algebra.operand(self.a, trans)))
        add_k = lambda v: v.select("i", F.lit(0).alias("k"), "re", "im")
        m = (lambda v: numeric.solve(self.factorize(), add_k(v), trans).select("i", "re", "im")) if preconditioned else None
        if preconditioned and p.incomplete >= 0:
            m = incomplete.factorize(cut(algebra.operand(self.a, trans)), p.incomplete).preconditioner(p.incomplete_steps)
        out = None
        for k in sorted(r[0] for r in b.select("k").distinct().collect()):
            of = lambda v, k=k: cut(v.where(F.col("k") == k).select("i", "re", "im"))
            options = {"eps": p.refine_epsilon, "most": p.refine_most}
            start = None if x is None else of(x)
            if p.refinement == "SR":
                self.log = refine.simple(a, of(b), start, m or (lambda v: v), **options)
            elif p.refinement == "GMRES":
                self.log = refine.gmres(a, of(b), start, m, restart=p.restart, **options)
            else:
                self.log = (refine.cg if p.refinement == "CG" else refine.bicgstab)(a, of(b), start, m, **options)
            one = self.log.x.select("i", F.lit(k).cast("int").alias("k"), "re", "im")
            out = one if out is None else out.unionByName(one)
        for f in (a, m):  # the results are tables of their own
            getattr(f, "release", lambda: None)()
        return out

    def run(self, start: str = "Init", end: str = "Clean", b: DataFrame | None = None) -> DataFrame | None:
        """The tasks from start to end; a later call may go on where one ended, or solve again. Returns x once there is one."""
        first, last = TASKS.index(start), TASKS.index(end)
        if first > last:
            raise ValueError(f"{end} comes before {start}")
        done = {"Factorize": self.analysis, "Solve": self.factor, "Refine": self.x}
        if start in done and done[start] is None:
            raise ValueError(f"{start} needs the tasks before it")
        tasks = TASKS[first : last + 1]
        if b is None and {"Solve", "Refine"} & set(tasks):
            raise ValueError("there is nothing to solve for without b")
        if "Init" in tasks:
            self.analysis = self.factor = self.x = None
        if {"Ordering", "Symbolic", "Analyze"} & set(tasks):
            self.analyze()
        if "Factorize" in tasks:
            self.factor = None
            self.factorize()
        if "Solve" in tasks:
            self.x = self.solve(b)
        if "Refine" in tasks:
            self.x = self.refine(b, self.x)
        x = self.x
        if "Clean" in tasks:
            self.analysis = self.factor = self.x = None
        return x

    def save(self, path: str) -> None:
        """Matrix, analysis and factor as tables, to be loaded in another session."""
        a, f = self.analyze(), self.factorize()
        tables = {"coo": self.a.coo, "ordering": a.ordering, "columns": a.columns, "tree": a.tree, "groups": a.groups, "lower": f.lower}
        tables |= {n: getattr(f, n) for n in ("d", "schur", "panels", "ranks", "fronts") if getattr(f, n) is not None}
        if f.kind == "LU":
            tables["upper"] = f.upper
        if self.a.dofs is not None:
            tables["dofs"] = self.a.dofs
        if f.tiled is not None:
            tables |= {"tiles": f.tiled.tiles, "places": f.tiled.places}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        about = {"tables": sorted(tables), "matrix": [self.a.n, self.a.kind, self.a.arithmetic, self.a.dof], "stages": a.stages, "front": a.front, "steps": f.tiled and sorted(f.tiled.steps.items()), "together": f.tiled and f.tiled.together, "kind": f.kind, "replaced": f.replaced, "first_schur": f.first_schur, "parameters": asdict(self.parameters)}
        self.a.coo.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Solver:
        """A solver as it was saved, with its factor."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        t = {name: spark.read.parquet(f"{path}/{name}") for name in about["tables"]}
        n, kind, arithmetic, dof = about["matrix"]
        s = cls(Matrix(t["coo"], n, kind, arithmetic, dof, t.get("dofs")), Parameters(**about["parameters"] | {"factorization": about["kind"]}), order=t["ordering"])
        s.analysis = numeric.Analysis(n, t["ordering"], t["columns"], t["tree"], t["groups"], about["stages"], about.get("front"))
        upper = t.get("upper", t["lower"] if about["kind"] in ("LLT", "LDLT") else t["lower"].withColumn("im", -F.col("im")))
        tiled = tiles.Tiled(t["tiles"], t["places"], dict(about["steps"]), about.get("together", 1)) if about.get("steps") else None
        s.factor = numeric.Factor(about["kind"], s.analysis, t["lower"], upper, t.get("d"), about["replaced"], t.get("schur"), about["first_schur"], s.a.is_complex, t.get("panels"), t.get("ranks"), tiled, t.get("fronts"))
        return s

    def _listed(self) -> DataFrame:
        """The listed unknowns (i) with their number in the Schur complement."""
        if self.listed is None:
            raise ValueError("there is no Schur complement")
        return graph.new_numbers(self.listed.select("i").distinct())

    def schur_values(self, y: DataFrame) -> DataFrame:
        """The components of the listed unknowns, numbered as the Schur complement's rows."""
        return y.join(self._listed(), "i").select(F.col("number").alias("i"), "k", "re", "im")

    def with_schur_values(self, y: DataFrame, values: DataFrame) -> DataFrame:
        """y with these components in place of those of the listed unknowns."""
        names = cut(self._listed())
        new = values.withColumnRenamed("i", "number").join(names, "number").select("i", "k", "re", "im")
        return y.join(names.select("i"), "i", "left_anti").select("i", "k", "re", "im").unionByName(new)

    def schur(self) -> DataFrame:
        """The Schur complement of the listed unknowns (i, j, re, im), in their ascending order."""
        return numeric.schur_complement(self.factorize())

    def schur_forward(self, b: DataFrame) -> DataFrame:
        """Right-hand side of the Schur system: components of the listed unknowns after the forward sweep."""
        return numeric.solve(self.factorize(), b, mode="Interface")

    def schur_backward(self, y: DataFrame) -> DataFrame:
        """All unknowns from a forward sweep whose listed components hold the Schur system's solution."""
        return numeric.solve(self.factorize(), y, mode="Backward")

    def check(self, b: DataFrame, x: DataFrame, trans: str | None = None) -> DataFrame:
        """Per right-hand side the backward error."""
        return algebra.check(algebra.operand(self.a, trans or self.parameters.trans), x, b)
