"""Every query of the subpackage against its SQL, on the given tables."""

import pytest
from compare import connect, difference

from slicelens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) is None


def test_entry_lists_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
