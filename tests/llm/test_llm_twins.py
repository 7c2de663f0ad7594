"""Queries of the subpackage against their SQL twins."""

import pytest
from oracle import connect, differences

from pageflow.llm.oracles import ORACLES
from pageflow.llm.queries import QUERIES


def test_names_and_twins():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(f"op{n}" for n in range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, root, name):
    assert differences(QUERIES[name](spark, root), connect(root), ORACLES[name]) == []
