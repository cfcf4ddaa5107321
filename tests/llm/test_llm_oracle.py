"""Training-data queries against their SQL on the small driver tables."""

import pytest
from test_oracle import duck  # noqa: F401  a fixture

from kgtide.llm import queries


def key(row):
    return [(v is not None, v) for v in row]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):  # noqa: F811
    ours = queries.queries()[name](spark, sf_dir)
    found = duck.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert sorted(ours.columns) == sorted(cols)
    assert sorted((tuple(r) for r in ours.select(cols).collect()), key=key) == sorted(found.fetchall(), key=key)
