"""Sharding by sampled splitters: equal bytes in every shard.

1. Keys are hashes of the texts, so copies lie together and any order of the input gives the same keys.
   A sample of keys, each as likely as its record is large (and bounded in number), gives quantile
   boundaries for `shards x fine` ranges.
2. The exact bytes of every range are counted. An overfull range is subdivided: a group of copies above
   its share of bytes by a hash that takes in the id, what else is in the range by another hash of the
   texts.
3. Consecutive ranges are put into shards by the running sum of bytes, and a record's slot is its
   range's first slot plus its number in the range. Only ids, sizes and checksums are shuffled; each
   task numbers one range, a small part of a shard.

Defined results: null texts have size 1 and checksum null; null and repeated ids are records like
all others; an empty table gives an empty result; extra columns are ignored. Records that agree in
all that is returned may swap slots. Copies share a shard unless their group has more bytes than one
of the `shards x fine` ranges should.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

LAW = "bytes"


def shard(docs: DataFrame, *, shards: int = 16, fine: int = 64, sample: int = 200_000, slack: float = 1.25, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null) and the columns of `carry` for every row.

    sample: bound on the keys that come to the driver; besides, one number for each of the `shards x
    fine` ranges and their parts does, a number that does not grow with the rows.
    """
    ranges = shards * fine
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_col).alias("crc"),
        F.xxhash64(text_col, F.lit(seed)).alias("key"),
        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry or [])],
    )
    keys = checkpoint(rows.select("id", "size", "crc", "key"))  # the texts are read once; with `carry`, once more at the end
    total = keys.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most")).first()
    if not total.n:
        bounds = []
    else:
        # A record is drawn with a chance in proportion to its size; the draw follows from its key and id.
        chance = F.col("size") * (sample / 2) / float(total.bytes)
        drawn = F.pmod(F.xxhash64("key", "id", F.lit(seed + 1)), F.lit(1 << 40)) / float(1 << 40) < chance
        weight = F.when(chance > 1, chance).otherwise(F.lit(1.0))
        got = keys.where(drawn).select("key", weight.alias("weight")).groupBy("key").agg(F.sum("weight").alias("weight")).limit(sample).toPandas().sort_values("key")
        at = np.cumsum(got["weight"].to_numpy())
        places = np.searchsorted(at, at[-1] * np.arange(1, ranges) / ranges) if len(at) else []
        bounds = np.unique(got["key"].to_numpy()[places]).tolist() if len(at) else []
    # Range r holds the keys in (bounds[r-1], bounds[r]].
    target = (total.bytes or 0) / ranges
    limits = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    keys = keys.withColumn("range", _place(limits, len(bounds), F.col("key")))
    weights = keys.groupBy("range").agg(F.sum("size").alias("bytes")).collect()  # at most shards x fine rows
    over = {r.range: r.bytes for r in weights if r.bytes > slack * target}
    # A key above its share is cut by ids; what else is in an overfull range is cut by key, so that copies stay together.
    hot = keys.where(F.col("range").isin(*over)).groupBy("range", "key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > target).collect() if over else []  # at most shards x fine rows
    hot.sort(key=lambda r: (r.range, r.key))
    rest = {r: n - sum(h.bytes for h in hot if h.range == r) for r, n in over.items()}
    parts = {r: max(1, int(np.ceil(n / target))) for r, n in rest.items()}
    within = F.lit(0)
    if over:
        by_range = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        within = F.pmod(F.xxhash64("key", F.lit(seed + 2)), F.coalesce(by_range[F.col("range")], F.lit(1))).cast("int")
    if hot:
        pieces, first = {}, dict(parts)
        for h in hot:
            n = int(np.ceil(h.bytes / target))
            pieces[h.key] = (first[h.range], n)
            first[h.range] += n
        start, many = (F.create_map(*[F.lit(x) for k, v in pieces.items() for x in (int(k), v[i])])[F.col("key")] for i in (0, 1))
        within = F.coalesce((start + F.pmod(F.xxhash64("id", "key", F.lit(seed + 3)), many)).cast("int"), within)
    cells = keys.withColumn("part", within).groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most shards x fine x 2 rows
    cells.sort(key=lambda r: (r.range, r.part))
    seen, filled, table = 0, [0] * shards, []
    for c in cells:
        middle = seen + c.bytes / 2
        s = min(shards - 1, int(middle * shards / total.bytes))
        table.append((c.range, c.part, s, filled[s]))
        filled[s] += c.n
        seen += c.bytes
    spark = docs.sparkSession
    places = spark.createDataFrame(table, "range int, part int, shard int, first long")
    order = W.partitionBy("range", "part").orderBy("key", "id", "size", "crc")
    rows = rows.withColumn("range", _place(limits, len(bounds), F.col("key"))) if carry else keys
    numbered = rows.withColumn("part", within).withColumn("number", F.row_number().over(order)).join(F.broadcast(places), ["range", "part"])  # as many rows as cells
    return numbered.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard",
        (F.col("first") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry or [])],
    )


def _place(limits: Column, n: int, key: Column) -> Column:
    """How many limits are below the key, by halving: log2(n) steps of comparisons, no loop over all limits."""
    if not n:
        return F.lit(0)
    low = F.aggregate(
        F.sequence(F.lit(1), F.lit(n.bit_length())),
        F.struct(F.lit(0).alias("a"), F.lit(n).alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s).otherwise(
            F.when(F.get(limits, F.shiftright(s["a"] + s["b"], 1)) < key, F.struct((F.shiftright(s["a"] + s["b"], 1) + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), F.shiftright(s["a"] + s["b"], 1).alias("b")))
        ),
        lambda s: s["a"],
    )
    return low


