import numpy as np
import pytest
from latticework.operators import algebra
from pyspark.sql import functions as F


def dense(entries, n):
    out = np.zeros((n, n), dtype=complex)
    for r in entries.collect():
        out[r.i, r.j] += r.re + 1j * r.im
    return out


@pytest.mark.parametrize("hot", [100_000, 6])
def test_products_of_neighbouring_indices_are_added_up_before_the_shuffle(spark, monkeypatch, hot):
    """Rows that the sums' shuffle takes: those of a range of inner indices, not of single ones; an index beyond HOT goes by a join."""
    monkeypatch.setattr(algebra, "HOT", hot)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(j), float(rng.integers(1, 9)), float(rng.integers(1, 9))) for j in range(40) for i in rng.choice(40, 3 if j else 12, replace=False)]
    a = spark.createDataFrame([*rows, (1, None, 5.0, 0.0)], "i long, j long, re double, im double").repartition(3)
    kept = a.where("j is not null")
    got = algebra.product(a, algebra.transpose(a), 2j)
    assert "RepartitionByExpression [m" in got._jdf.queryExecution().optimizedPlan().toString()
    x = dense(kept, 40)
    assert np.array_equal(dense(got, 40), 2j * (x @ x.T))
    assert got.groupBy("i", "j").count().where(F.col("count") > 1).count() == 0


def test_product_without_entries_in_common(spark):
    a = spark.createDataFrame([(0, 1, 2.0, 0.0)], "i long, j long, re double, im double")
    assert algebra.product(a, a).count() == 0
    assert algebra.product(a.where("false"), a).count() == 0


@pytest.mark.parametrize("hot", [100_000, 6])
def test_gram_makes_one_triangle_and_moves_entries_once(spark, monkeypatch, hot):
    monkeypatch.setattr(algebra, "HOT", hot)
    rng = np.random.default_rng(4)
    rows = [(int(i), int(j), float(rng.integers(1, 9)), float(rng.integers(1, 9))) for j in range(40) for i in rng.choice(40, 3 if j else 12, replace=False)]
    # an entry that is there twice, one without a column, and columns beyond the diagonal
    a = spark.createDataFrame([*rows, rows[0], rows[5], (1, None, 5.0, 0.0)], "i long, j long, re double, im double").repartition(3)
    d = spark.createDataFrame([(j, j + 1.0, 0.5 * j) for j in range(36)] + [(None, 1.0, 0.0), (50, 1.0, 0.0)], "i long, re double, im double")
    x = dense(a.where("j is not null"), 40)
    scale = np.array([j + 1.0 + 0.5j * j if j < 36 else 0 for j in range(40)])
    for by, want in ((None, x @ x.T), (d, x * scale @ x.T)):
        got = algebra.gram(a, by, 2j)
        assert np.array_equal(dense(got, 40), 2j * want)
        assert got.groupBy("i", "j").count().where("count > 1").count() == 0
        assert np.array_equal(dense(algebra.gram(a, by, lower=True), 40), np.tril(want))
    plan = algebra.gram(a, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Generate explode(ls") == 2


def test_gram_without_entries_in_common_or_with_rows_that_have_no_number(spark):
    a = spark.createDataFrame([(0, 1, 2.0, 0.0), (None, 1, 3.0, 0.0), (None, 1, 1.0, 0.0)], "i long, j long, re double, im double")
    assert algebra.gram(a.where("false")).count() == 0
    assert sorted(map(str, algebra.gram(a).select("i", "j", "re").collect())) == sorted(map(str, algebra.product(a, algebra.transpose(a)).select("i", "j", "re").collect()))
