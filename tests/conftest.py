import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hazardspark.session import release, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "6g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()
