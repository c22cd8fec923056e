"""Every query of the engine against its SQL."""

import os

import pytest

from gridweave.plans import catalog

from .conftest import DATA


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(agree, name):
    agree(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_query_has_a_name():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
