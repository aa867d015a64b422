import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from paraforge.session import SCALE_CONFS, checkpoint_dir

    builder = (SparkSession.builder.master(os.environ.get("PARAFORGE_MASTER", "local[*]")).appName("paraforge-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for k, v in SCALE_CONFS.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
