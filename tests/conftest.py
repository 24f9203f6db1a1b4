import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pointloom.session import local_session, ship

    s = local_session(4, "3g", spark__sql__shuffle__partitions="4")
    ship(s)
    yield s
    s.stop()
