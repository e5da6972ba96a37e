import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from codexa.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, name="tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
