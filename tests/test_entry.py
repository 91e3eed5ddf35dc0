"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
import compare  # noqa: E402

from mnemospark.plans import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.views(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    if name in registry.sql():
        want = duck.execute(registry.sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert compare.norm(got) == compare.norm(want)
