"""Registered code-graph tools against their SQL."""

import pytest
from compare import same

from quiltgraph import code_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(code_queries.ORACLES))
def test_tool(spark, name):
    same(code_queries.QUERIES[name](spark, SF), SF, code_queries.ORACLES[name])
