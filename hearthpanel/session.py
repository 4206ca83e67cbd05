"""Session settings used by the tests and the bench; a cluster brings its own session."""

from __future__ import annotations

import re
import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("hearthpanel")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="hearthpanel-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Where the setting is absent, a session that runs in one process (tests, the bench) gets a local folder; on a
    cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _test_folder()


def keep_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder unless the session already has a place for them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(spark: SparkSession, df: DataFrame, *by: str) -> DataFrame:
    """`df` written once to the shared folder and read back, so that later rounds do not recompute earlier ones.

    A filter on the columns `by` reads their rows only.
    """
    path = f"{shared_folder(spark)}/cuts/{uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(df.columns) if by else back  # the columns `by` come last in files


_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def stored(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """The table `name` derived from the folder `source`, written once per application.

    Reports and estimation jobs read a finished panel, as Parquet partitioned by year in the shared
    folder, instead of deriving it again for each pass over the data.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/panels/{uuid4().hex}/{name}"
        frame = build()
        frame.write.partitionBy("year").parquet(path)
        _WRITTEN[key] = path, frame.schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)
