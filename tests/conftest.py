import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestone.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}",
    })
    s.sparkContext.setLogLevel("ERROR")
    from lodestone.session import worker_path

    worker_path(s)
    return s
