"""Every registered query on the given tables: against SQL where there is one, else rows and columns."""

import pytest
from llm_checks import same_rows

from rankloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, duck, data, name):
    same_rows(registry.QUERIES[name](spark, data), duck, registry.ORACLE[name])


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
