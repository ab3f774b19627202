"""Session settings the operators rely on."""

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable with other engines; AQE splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores="*", partitions=8, memory="8g"):
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark, sf_dir, name):
    """Read one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark):
    """spark.checkpoint.dir, the folder that the driver and all executors share; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: One folder for each driver process; it goes when the process ends.
RUN = uuid.uuid4().hex
_ROOTS = set()


def _remove(spark, path):
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm or SparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


def stored(df, name):
    """Write a frame to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/steps-{RUN}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
