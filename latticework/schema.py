"""Tables of sparse linear algebra: matrices, vectors, orderings and symbolic structures.

A matrix is a DataFrame of its entries, a vector one of its components; complex numbers are pairs
of columns, with im = 0 for real ones. Indices start at 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

COO = "i long, j long, re double, im double"
VEC = "i long, k int, re double, im double"
EDGE = "i long, j long"
ORDERING = "i long, perm long"

GENERAL, SYMMETRIC, HERMITIAN = "General", "Symmetric", "Hermitian"
ARITHMETIC = ("Pattern", "Float", "Double", "Complex32", "Complex64")


@dataclass(frozen=True)
class Matrix:
    """A square sparse matrix. Symmetric and Hermitian ones store one triangle. dof: unknowns of each vertex, which follow each other; dofs: where vertices have different numbers of them, (i, begin, end) per vertex."""

    coo: DataFrame
    n: int
    kind: str = GENERAL
    arithmetic: str = "Double"
    dof: int = 1
    dofs: DataFrame | None = None

    @property
    def is_complex(self) -> bool:
        return self.arithmetic.startswith("Complex")
