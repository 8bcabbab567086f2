import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dupstream.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8,
                      extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from tools.compare import duck as make
    return make(SF0001)
