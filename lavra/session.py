"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "lavra") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", shuffle_partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str = "tmp") -> str:
    """A fresh path in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Where it is unset a
    local session (tests on one machine) gets a temporary folder, another an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_lavra_dir", None)
        if not base:
            base = spark._lavra_dir = tempfile.mkdtemp(prefix="lavra-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base.rstrip('/')}/lavra-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


#: Folders this process has made in the shared folder.
_WRITTEN: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Deletes what this process has written to the shared folder, once the results that read it are done; how many folders went."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def materialize(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that a result used several times is computed once and
    survives the loss of executors.
    """
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession, df: DataFrame, *columns: str) -> DataFrame:
    """``df`` hashed by ``columns`` over all cores: for work that is much for its bytes, which would be gathered in few tasks."""
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns)
