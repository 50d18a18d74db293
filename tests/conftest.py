import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workfold.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", 4, spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
        workfold__sharedDir=str(tmp_path_factory.mktemp("shared")), workfold__rowsPerCell="1500")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_cells(spark):
    """Force the cell path on small inputs."""
    before = spark.conf.get("workfold.rowsPerCell")
    spark.conf.set("workfold.rowsPerCell", "40")
    yield
    spark.conf.set("workfold.rowsPerCell", before)
