"""Every registered query of the library against its oracle SQL, and the rest for their rows."""

import pytest

from matchloom.plans import block_queries, model_queries, scalar_queries

PARTS = (block_queries, scalar_queries, model_queries)
Q = {k: v for p in PARTS for k, v in p.queries().items()}
SQL = {k: v for p in PARTS for k, v in p.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, same):
    same(Q[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_rows(name, spark, sf_dir):
    assert Q[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    r = e.entry(spark).first()
    assert r.candidate_pairs >= r.recovered_pairs > 0
