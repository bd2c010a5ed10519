import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
PATHS = [os.path.dirname(HERE), HERE, os.path.join(HERE, "llm")]
sys.path[:0] = PATHS
# Python workers import the test modules that their functions come from.
os.environ["PYTHONPATH"] = os.pathsep.join([*PATHS, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
