"""A map of bits that rows are held against before a join, so that few of those without a partner are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 15, 28
"""The map has eight to sixteen bits a key, and 2^28 (32 MB) at most; with more keys more rows pass."""
PIECE_BYTES = 64
"""A map goes out in pieces, as a row that looks one bit up reads a whole piece."""
PART_PIECES = 4096 // PIECE_BYTES


def maybe_among(rows: DataFrame, hashes: Column, keys: DataFrame, name: str = "maybe") -> DataFrame:
    """`rows` with a boolean column `name`: may `hashes` (bigint) be in the one column of the saved table `keys`?

    It is true for all that are and for about a tenth of the others. Keys are hashes, as others would crowd few places.
    A null hash is among nothing.
    """
    bits = F.lit(1 << min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length())))
    place = F.pmod(F.col(keys.columns[0]), bits)
    marked = keys.select(F.bitmap_bucket_number(place).alias("_part"), F.bitmap_bit_position(place).alias("_at")).repartition("_part")
    parts = marked.groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_map"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(PART_PIECES - 1)), lambda k: F.struct(
        (F.col("_part") * PART_PIECES + k).alias("_place"), F.substring("_map", k * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias("_piece")))
    pieces = parts.select(F.inline(cut))
    mine = F.pmod(hashes, bits)
    at = F.bitmap_bit_position(mine).cast("int")
    here = F.bitmap_bucket_number(mine) * PART_PIECES + F.shiftright(at, (8 * PIECE_BYTES).bit_length() - 1) == F.col("_place")
    byte = F.substring("_piece", F.shiftright(at, 3).bitwiseAND(F.lit(PIECE_BYTES - 1)) + 1, F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), at.bitwiseAND(F.lit(7))) == 1
    return rows.join(F.broadcast(pieces), here, "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(found, F.lit(False)).alias(name))
