"""Intermediate tables, written to the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from hearthpanel.session import shared_folder


_OPEN: list[list[str]] = []
_LAST: list[str] = []


@contextmanager
def stage_scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted when the next such stage begins.

    By then the stage's result, which reads them, must be written. Tables saved elsewhere are never deleted.
    """
    for path in _LAST:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _LAST.clear()
    _OPEN.append([])
    try:
        yield
    finally:
        _LAST.extend(_OPEN.pop())


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks of later stages only, and the table is
    computed once however often it is used. Column types stay as they are.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm/{uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")
