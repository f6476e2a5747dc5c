"""Every registered query of the library itself, against its SQL where there is one."""

import oracle
import pytest

from tonewright.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf_dir, con, name):
    assert oracle.compare(registry.QUERIES[name](spark, sf_dir), con, registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
