from __future__ import annotations

import pytest

from pressloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
