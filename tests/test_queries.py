import os

import pytest

from herdbook.plans import catalogue
from oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, catalogue.QUERIES[name], catalogue.SQL[name])


def test_core_imports_no_llm():
    here = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "herdbook")
    for folder, _, files in os.walk(here):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "herdbook.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
