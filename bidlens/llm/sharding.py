"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm.common import table

# Slots of the production table (a prime) and its shards.
SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's preference order; a step below a prime visits every slot."""
    first, step = (int.from_bytes(hashlib.md5(f"{kind}:{shard}".encode()).digest()[:8], "big") for kind in ("first", "step"))
    return first % slots, step % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard: in turns, every shard claims its next free preferred slot.

    ``slots`` must be a prime not below the number of shards, which must differ from one another.
    """
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("slots must be a prime, shards distinct and at most as many")
    owner = [-1] * slots
    at = [preference(s, slots) for s in shards]
    step = [s for _, s in at]
    at = [f for f, _ in at]
    left = slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, instead: list[str] = ()) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``, by the digest of the key as text.

    Rows of one key share a shard. Null keys would all meet in one slot, so the columns in ``instead``
    place them. The table has ``slots`` rows whatever the input, so it is broadcast. Existing columns
    ``slot`` and ``shard`` are replaced.
    """
    spark = rows.sparkSession
    lookup = spark.createDataFrame([(s, shards[i]) for s, i in enumerate(lookup_table(shards, slots))], "slot long, shard string")
    other = F.concat_ws("\x00", F.lit("row"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x01")) for c in instead])
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), other).cast("binary"))
    slot = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)
    return rows.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(lookup), "slot").select(
        *[F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard")], "slot", "shard"
    )


def write_shards(placed: DataFrame, path: str, files: int = 1) -> None:
    """One folder per shard with about ``files`` files each; rows are dealt by slot, so no shard is one task."""
    deal = F.pmod(F.xxhash64("slot"), F.lit(files))
    placed.repartition("shard", deal).write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return place(docs, "doc_id", shard_names(), instead=["lang", "source", "n_chars"])
