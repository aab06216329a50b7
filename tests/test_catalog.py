"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import pytest
from oracle import difference

from parchmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        assert difference(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0
