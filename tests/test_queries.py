"""Every registered query that SQL can express gives DuckDB's rows at the smallest scale; the others give rows."""

import os

import pytest

from catalith.plans import registry
from tests.compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    sql = registry.oracle_sql().get(name)
    out = registry.queries()[name](spark, SF)
    if sql:
        assert difference(out, sql, SF) == ""
    else:
        assert out.limit(1).count() == 1
