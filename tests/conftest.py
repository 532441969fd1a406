import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from regionspark import session

    work = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(work / "warehouse")).config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    root = str(Path(__file__).resolve().parents[1])
    s.sparkContext.environment["PYTHONPATH"] = root
    session.configure(s)
    s.conf.unset("spark.sql.streaming.stateStore.providerClass")
    yield s
    s.stop()
