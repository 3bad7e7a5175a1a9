"""Rows that may have a key of others, told by bits that every task gets, before an exact join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that keys are hashed to, 16 MB in all, and those of one row of the broadcast table (what bitmap_construct_agg holds).
BITS, WORD = 1 << 27, 32_768


def may_be_among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows without most of those whose columns `on` have no equal in keys; none with an equal goes.

    A semi or inner join has to follow. Of n keys a row with none of them stays with a chance of about n / BITS.
    """
    same = [F.col(c).cast(rows.schema[c].dataType) for c in on]
    places = keys.select(F.pmod(F.xxhash64(*same), F.lit(BITS)).alias("_place"))
    places = places.select(F.floor(F.col("_place") / WORD).alias("_word"), (F.col("_place") % WORD).alias("_at")).repartition("_word")
    bits = places.groupBy("_word").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    place = F.pmod(F.xxhash64(*on), F.lit(BITS))
    at = (place % WORD).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), (F.floor(place / WORD) == F.col("_word")) & (F.getbit(byte, at % 8) == 1), "left_semi")
