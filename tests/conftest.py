import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from txnrisk.session import ENGINE_CONF, checkpoint_dir
    b = (SparkSession.builder.master("local[*]").appName("txnrisk-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g")
         # tests set their own shared folder; a cluster names it in its config
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="txnrisk-test-", dir="/tmp")))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
