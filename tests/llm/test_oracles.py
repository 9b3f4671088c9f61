import os

import pytest

from quillon.llm import queries
from tests import comparing

pytestmark = pytest.mark.skipif(not os.path.isdir(comparing.FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert not comparing.differs(spark, comparing.connection(), queries.queries()[name], queries.oracle_sql()[name])
