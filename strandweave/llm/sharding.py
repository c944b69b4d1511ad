"""Operator 10: sharding by rendezvous hashing.

Every record key scores every shard with ``-weight / ln(u)``, ``u`` being a uniform number that
only the key and the shard decide; the best score takes the record. A shard that is added can
only win records for itself, a shard that is removed only gives its own away, and weights set
the expected shares. Everything is a DataFrame expression; text is read once, for its checksum,
and scored once: slots are counted on what is written then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import small_or_not
from .common import table, written

#: Shards of the registered query.
SHARDS = 24
#: Slot groups per shard.
GROUPS = 4096


def _uniform(digest: Column, shard: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(digest, F.lit(shard)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def scores(digest: Column, weights: list[float], first: int = 0) -> list[Column]:
    """One struct (score, negated shard) for each shard; the greatest struct wins, the lowest
    shard on a tie. ``digest`` is the key's 64-bit hash."""
    return [
        F.struct((F.lit(-float(w)) / F.ln(_uniform(digest, i))).alias("score"), F.lit(-i).alias("neg"))
        for i, w in enumerate(weights, first)
    ]


def rendezvous(df: DataFrame, key: str, weights: list[float], grow: float | None = None) -> DataFrame:
    """Adds ``shard`` and, with ``grow`` (the weight of one more shard), ``grown_shard``.

    Nulls: a null key is treated as the text ``null`` and so has one fixed shard. Repeated keys
    share a shard by construction. An empty table gives an empty table. Columns of ``df`` named
    ``shard`` or ``grown_shard`` are replaced, all others are kept.
    """
    if not weights or min(weights) <= 0 or (grow is not None and grow <= 0):
        raise ValueError("weights must be positive and at least one shard is needed")
    own = [next(n for n in (f"{x}{'_' * i}" for i in range(len(df.columns) + 1)) if n not in df.columns) for x in ("digest", "best", "more")]
    digest, best, more = own
    out = df.withColumn(digest, F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    out = out.withColumn(best, F.array_max(F.array(*scores(F.col(digest), weights))))
    if grow is not None:
        out = out.withColumn(more, F.greatest(F.col(best), scores(F.col(digest), [grow], len(weights))[0]))
        out = out.withColumn("grown_shard", (-F.col(f"{more}.neg")).cast("int"))
    return out.withColumn("shard", (-F.col(f"{best}.neg")).cast("int")).drop(*own)


def slots(df: DataFrame) -> DataFrame:
    """Adds ``slot``: places in each shard, gapless from 0. ``df`` is evaluated once and written.

    No task holds a whole shard: rows are dealt into GROUPS groups per shard by a hash of their
    place in the table, whatever their keys, ranked inside their group, and the groups' sizes,
    summed beforehand, give each group's first slot. Repeated keys and rows, null ones too, thus
    make no large group. Columns of ``df`` keep their names; ``slot`` is replaced.
    """
    place = F.monotonically_increasing_id()
    keyed = df.select("shard", F.struct(*df.columns).alias("row"), place.alias("place"))
    keyed = written(keyed.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(GROUPS))))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    first = small_or_not(written(sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("place")))
    slot = (F.col("first") + F.col("rank") - 1).cast("bigint")
    return ranked.join(first, ["shard", "part"]).select("row.*", slot.alias("slot_")).drop("slot").withColumnRenamed("slot_", "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 23 by the law ``key``: doc_id and the shard count decide.

    Nulls: a null text has size 8 and checksum 0; a null doc_id is placed as key ``null``.
    Repeated rows are all placed, each in a slot of its own, on the shard of their key. Very long
    texts are measured where they are read and do not move. Ties in score go to the lowest shard.
    An empty table gives no rows. Extra columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(
        "doc_id", (F.octet_length(data) + 8).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")
    )
    placed = rendezvous(sized, "doc_id", [1.0] * SHARDS, grow=1.0)
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
