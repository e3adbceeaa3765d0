import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyard.runtime import session

    shared = tmp_path_factory.mktemp("shared")
    made = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(shared), "spark.sql.warehouse.dir": str(shared / "warehouse"), "spark.driver.host": "127.0.0.1"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
