import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import session

    out = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("checkpoints")))
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
