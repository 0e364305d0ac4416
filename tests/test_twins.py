import pytest
from conftest import SF
from twins import connect, differences

from tidewell.catalog import CORE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, CORE[name], SF) == []
