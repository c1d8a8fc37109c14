import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "3")
        # tiny tables: compiling a plan takes longer than interpreting it (the driver's runs and bench.py compile)
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from foliant.plans.ship import ship

    ship(s)
    yield s


@pytest.fixture(scope="session")
def small():
    return os.environ.get("FOLIANT_TESTDATA", "/root/testdata/sf0.001")
