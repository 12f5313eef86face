"""Sharding by weighted rendezvous hashing.

Every shard scores every key, ``-ln(u) / weight`` with u drawn by hashing (key,
shard); the least score wins.  A key's shard depends on the key and the shards
alone, and one more shard only takes keys into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_rank, fresh


def score(key: Column, shard: int, weight: float) -> Column:
    """First 48 bits of md5("key:shard") as u in (0, 1); smaller scores win."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / F.lit(float(weight))


def shard(df: DataFrame, key: str, text: str, weights: list[float], grown: float | None = None) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to ``df``.

    ``weights`` gives one positive weight a shard; ``grown`` is the weight of
    one shard more.  Null text has no bytes and CRC 0; a null key is hashed as
    "\\N", so such rows share a shard.  Slots run gapless from 0 in each shard,
    rows of equal key and text in any order among themselves, each with a slot.
    A score that several shards share goes to the lowest.  Empty tables give
    empty results; other columns pass through, whatever their names; columns of
    the names added are replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    name = F.coalesce(F.col(key).cast("string"), F.lit("\\N"))
    won = fresh(df, "won")
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = df.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard").withColumns({
        "size": (F.octet_length(bytes_) + 8).cast("long"),
        "text_crc32": F.crc32(bytes_).cast("long"),
        "law": F.lit("key"),
        won: F.array_min(F.array(*[F.struct(score(name, j, w).alias("s"), F.lit(j).alias("j")) for j, w in enumerate(weights)])),
    })
    more = F.lit(None).cast("int") if grown is None else F.when(score(name, len(weights), grown) < F.col(won)["s"], F.lit(len(weights))).otherwise(F.col(won)["j"])
    out = out.withColumns({"shard": F.col(won)["j"], "grown_shard": more}).drop(won)
    return dense_rank(out, ["shard"], [key, "size", "text_crc32"], "slot")
