import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(work / "warehouse")).config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from motionframe.session import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def _uncached(spark):
    """What a module's tests have cached goes with them."""
    yield
    spark.catalog.clearCache()
