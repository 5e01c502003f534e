"""One session for all tests of a process."""

import os
import sys
import tempfile
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def make_session():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *os.environ.get("PYTHONPATH", "").split(os.pathsep)]))
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    b = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", own).config("spark.sql.warehouse.dir", own + "/warehouse").config("spark.driver.memory", "4g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark
