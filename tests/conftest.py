import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelspark.session import get_session
    s = get_session(app="panelspark-tests", master="local[4]", shuffle_partitions=8,
                    extra={"spark.driver.memory": "6g",
                           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="panelspark-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
