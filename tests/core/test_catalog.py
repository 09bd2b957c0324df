import duckdb
import pytest
from latticework.operators import joins
from latticework.plans import catalog, tables  # noqa: F401

from .. import TABLES, TINY

#: Solvers are tested on their own.
QUICK = [n for n in catalog.QUERIES if not n.startswith(("solve_", "refine_", "schur", "mesh_solution", "mesh_low_rank"))]


def plain(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


def rows(names, data):
    return sorted((tuple(sorted((n, plain(v)) for n, v in zip(names, r, strict=True))) for r in data), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, TINY)
    got = rows(df.columns, df.collect())
    assert got
    if name in catalog.SQL:
        cur = con.execute(catalog.SQL[name])
        assert got == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name,least", [("scaled_product", 20), ("matrix_product", 30), ("permute_matrix", 100), ("integer_set_union", 100)])
def test_whole_tables(spark, name, least):
    """On a table with more ids than the queries over subsets keep."""
    small = TINY.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, small)
    got = df.collect()
    cur = con.execute(catalog.SQL[name])
    assert rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())
    assert len({r.j for r in got}) > least
    if name == "permute_matrix":
        assert len(got) == con.execute("select count(*) from (select distinct l_suppkey, l_partkey from lineitem)").fetchone()[0]


@pytest.mark.parametrize("name", ["symmetrize", "graph_prepare", "integer_set_union", "factor_difference", "permute_matrix"])
def test_a_large_table_is_dealt_to_more_partitions(spark, monkeypatch, name):
    """A task's share of a table does not grow with it: more partitions than shuffles have, with the same rows."""
    few = catalog.QUERIES[name](spark, TINY)
    monkeypatch.setattr(joins, "ROWS", 500)
    many = catalog.QUERIES[name](spark, TINY)
    parts = -(-catalog.table(spark, TINY, "lineitem").count() // 500)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert parts > 4 and f", {parts}" in plan
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
