import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from splitframe import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session("8", "tests", **{"spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
