"""Sharding by jump consistent hashing: stable keys go to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthpanel.llm.store import saved


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key.

    Each key jumps ahead through the shard numbers with a generator of its own; its shard is the last
    stop before `shards`. With one shard more, a key stays or moves to the new shard.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    following = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = following[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        following[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[following[moving] < shards]
    return shard.astype(np.int32)


@F.pandas_udf(T.IntegerType())
def _jump(key: pd.Series, shards: pd.Series) -> pd.Series:
    out = np.zeros(len(key), dtype=np.int32)
    counts = shards.to_numpy()
    for count in np.unique(counts):
        own = counts == count
        out[own] = jump_hash(key.to_numpy()[own].view(np.uint64), int(count))
    return pd.Series(out)


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to `shards` - 1 of a bigint key; a null key counts as 0."""
    return _jump(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")), F.lit(shards))


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its shard and a gapless place (`slot`) in it.

    Returns `key`, size (UTF-8 bytes of the text plus 8), text_crc32, law ('key'), shard, slot and
    grown_shard (the shard when there is one more). The key and the number of shards alone decide the
    shard, so equal keys meet in one shard; rows of one shard are numbered from 0. Places are given
    per input split: the splits of a shard follow each other, and the rows of a split are ordered by
    key. A shard of any size, or a key that a third of all rows share, is therefore numbered by as many
    tasks as it has input splits. Texts stay where they are read.

    Null key: shard of key 0. Null text: size 8, crc of the empty string. Repeated rows each get a
    place. No rows give no rows. Other columns of `docs` are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(body).cast("bigint") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("split"))
    rows = rows.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1)})
    rows = saved(rows, "sharded")
    counts = rows.groupBy("shard", "split").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("shard").orderBy("split")
    offsets = counts.select("shard", "split", (F.sum("n").over(running) - F.col("n")).alias("offset"))
    order = Window.partitionBy("shard", "split").orderBy(key, "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(order)).join(offsets, ["shard", "split"])
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("offset") + F.col("place") - 1).alias("slot"), "grown_shard")
