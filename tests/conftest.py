import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from factlake.session import build_session

    session = build_session(
        "factlake-tests", master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark):
    """Force the plan for large sides, with blocks of a few rows."""
    settings = {"broadcastRows": "0", "blockRows": "16", "pivots": "6"}
    for name, value in settings.items():
        spark.conf.set(f"factlake.similarity.{name}", value)
    yield
    for name in settings:
        spark.conf.unset(f"factlake.similarity.{name}")
