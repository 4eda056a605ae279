import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the tests' own classes, too.
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])

from lodestar.session import local_session, shared_dir


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4"})
    shared_dir(session)
    yield session
    session.stop()
