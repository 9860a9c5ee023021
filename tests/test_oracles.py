"""The driver's correctness gate, locally: queries against their DuckDB oracles at sf0.01."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

SF = "/root/testdata/sf0.01"
LLM = set(E._llm_queries())
NAMES = sorted(set(E.oracle_sql()) - LLM)  # those of the llm folder have their own tests


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}
    want = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for column, kind in df.dtypes:
        assert types.get(kind, want[column]) == want[column], column
    assert compare(df.toPandas(), rel.df()) is None


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["row_id", "step", "scores"]
    assert df.count() > 0


def test_error_loop_stops_like_the_oracle(spark, con):
    import numpy as np

    from matstream.plans.sketch import sketch_svd

    res = sketch_svd(E._rows(spark, SF), k=1, subsample=1, max_iter=5, tolerance=0.1, calc_error=True, q=10,
                     subsample_norm=1, seed="validation")
    want = con.sql(E._sketch_error_k1_sql(5, 10, 0.1)).df().sort_values("round")
    assert len(res.errors) == len(want) < 5   # stopped early, at the same round
    assert np.allclose(np.round(res.errors, 6), want.rel_error.to_numpy(), atol=1e-6)
