"""Parameters of the solver: names, defaults, checks, and a table of them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: Names of enumerations in their numeric order.
NAMES = {
    "factorization": ("LLH", "LDLT", "LU", "LLT", "LDLH"),
    "refinement": ("GMRES", "CG", "SR", "BiCGSTAB"),
    "ordering": ("Dissection", "Grid", "Personal", "Identity"),
    "trans": ("NoTrans", "Trans", "ConjTrans"),
    "norm": ("One", "Frobenius", "Inf", "Max"),
    "arithmetic": ("Pattern", "Float", "Double", "Complex32", "Complex64"),
    "compress_when": ("Never", "JustInTime", "MinimalMemory"),
    "compress_method": ("SVD", "PQRCP", "RQRCP", "TQRCP", "RQRRT"),
    "matrix": ("General", "Symmetric", "Hermitian"),
}
BYTES = {"Pattern": 0, "Float": 4, "Double": 8, "Complex32": 8, "Complex64": 16}


def parse(kind: str, name: str) -> int:
    """Number of a name, whatever its case."""
    low = [x.lower() for x in NAMES[kind]]
    if name.lower() not in low:
        raise ValueError(f"{name} is no {kind}")
    return low.index(name.lower())


def name_of(kind: str, number: int) -> str:
    return NAMES[kind][number]


@dataclass
class Parameters:
    factorization: str | None = None
    ordering: str = "Dissection"
    leaf: int = 24
    amalgamation: float = 0.05
    limit: int = 20_000
    share: int = 50_000
    front: int = 6_000
    tile: int = 1_024
    incomplete: int = -1
    incomplete_steps: int = 6
    epsilon: float = 0.0
    refinement: str = "GMRES"
    refine_epsilon: float = 1e-12
    refine_most: int = 250
    restart: int = 25
    trans: str = "NoTrans"
    mixed: bool = False
    compress_when: str = "Never"
    compress_method: str = "PQRCP"
    compress_tolerance: float = 1e-8
    compress_least_width: int = 128
    compress_least_height: int = 20
    compress_rows: int = 256

    def __post_init__(self) -> None:
        for kind in ("factorization", "refinement", "ordering", "trans", "compress_when", "compress_method"):
            value = getattr(self, kind)
            if value is not None:
                setattr(self, kind, NAMES[kind][parse(kind, value)])
        for low in ("leaf", "limit", "share", "front", "tile", "restart", "refine_most", "incomplete_steps", "compress_rows"):
            if getattr(self, low) < 1:
                raise ValueError(f"{low} must be positive")
        if not 0 <= self.amalgamation or self.refine_epsilon < 0 or self.compress_tolerance < 0:
            raise ValueError("ratios and tolerances are not negative")

    def table(self, spark: SparkSession) -> DataFrame:
        """name, value: what a run's parameter file holds."""
        return spark.createDataFrame([(f.name, str(getattr(self, f.name))) for f in fields(self)], "name string, value string")


def names_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(kind, n, x) for kind, values in NAMES.items() for n, x in enumerate(values)], "kind string, number int, name string")
