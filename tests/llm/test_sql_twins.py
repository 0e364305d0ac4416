import pytest
from conftest import SF
from twins import connect, differences

from tidewell.llm.queries import LLM


@pytest.mark.parametrize("name", sorted(n for n, q in LLM.items() if q.sql))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connect(SF), LLM[name], SF) == []
