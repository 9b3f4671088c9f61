import os

import pytest

from quillon import catalog
from tests import comparing

ORACLE = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(comparing.FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return comparing.connection()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert not comparing.differs(spark, con, catalog.queries()[name], ORACLE[name])
