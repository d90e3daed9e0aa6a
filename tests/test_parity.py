"""Every registered query against its checking SQL on the smallest test data."""

import os

import pytest

import parity
from conftest import SF
from tesserine.plans import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    assert parity.check(spark, con, SF, key, QUERIES[key], ORACLES.get(key)) is None


def test_only_documented_keys_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"similar_pairs_lsh"}
