"""Mixing sources to target weights by subset-sum budget fitting.

For each source, whole passes over its documents fill as much of the target as fits; the remaining
budget is fitted exactly, or as nearly as the lengths allow: documents are counted by exact length,
each length gives its proportional share (rounded down), the longest documents that still fit shrink
what is left, and a bounded-knapsack dynamic programme over the last `reach` words finds the subset
of the remaining counts that comes nearest. Which documents of a length are taken follows from a
seeded hash of their ids.

Only counts by (source, length) meet in one task, never the documents: those are numbered within
salted cells, whose number grows with the rows, so a hot source or length is spread.

Defined results: null and wordless texts have size 0 and nothing is taken of them; null is a source
of its own, the last; repeated rows are documents each; an empty table gives an empty result; extra
columns are ignored by `mix` and kept by `mixed`.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

#: A document counts at most so many times.
PASSES = 3
WEIGHTS = (1.0, 2.0, 3.0)


def size_of(text: Column) -> Column:
    """Number of words [^\x20\x09-\x0D]+, null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = PASSES) -> list[float]:
    """Shares of the sum of all sizes by weight; none above `most` times its size, the excess shared again."""
    out, free, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n], float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * float(sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, reach: int = 1 << 15) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum up to `budget` or nearly so."""
    total = int(lengths @ counts)
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int(lengths @ take)
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # the longest first, until what is left is within reach of the programme
        if left <= reach:
            break
        more = min(int(counts[i] - take[i]), (left - reach // 2) // int(lengths[i])) if lengths[i] <= left - reach // 2 else 0
        take[i] += more
        left -= more * int(lengths[i])
    # Bit b of `sums` says that the items so far reach b words; binary splitting bounds each count.
    if left > reach:  # no document fits: one more of the shortest if that comes nearer
        i = order[counts[order] > take[order]][-1]
        take[i] += abs(int(lengths[i]) - left) < left
        return take
    limit, sums = (1 << (left + min(reach, int(lengths[order[0]])) + 1)) - 1, 1
    trail: list[tuple[int, int, int]] = []
    for i in order[::-1]:
        n, size, piece = int(counts[i] - take[i]), int(lengths[i]), 1
        while n > 0 and size * piece < limit.bit_length():
            piece = min(piece, n)
            trail.append((i, piece, sums))
            sums |= (sums << (size * piece)) & limit
            n -= piece
            piece *= 2
        if sums >> left & 1:
            break
    below = (sums & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = sums >> (left + 1)
    over = (above & -above).bit_length() + left if above else None
    goal = below if over is None or left - below <= over - left else over
    for i, piece, before in reversed(trail):
        if not before >> goal & 1:
            take[i] += piece
            goal -= piece * int(lengths[i])
    return take


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.0, seed: int = 42, cell_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """id, size, source_size, target, taken for every row; `row` (all columns) too with `carry`.

    weights: in turn for the sources by code point, null last. budget: in sums of all sizes. The sizes
    of the sources, one row each, come to the driver.
    """
    size = size_of(F.col(f"`{text_col}`"))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    small = checkpoint(keyed.select("id", "source", "size"))  # the texts are read once; with `carry`, once more at the end
    sources = sorted(small.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    target = [t * budget for t in targets([r.size for r in sources], [weights[i % len(weights)] for i in range(len(sources))], PASSES / budget)]
    spark = docs.sparkSession
    plan = spark.createDataFrame([(i, r.source, r.size, t) for i, (r, t) in enumerate(zip(sources, target))], "s int, source string, source_size long, target double")
    cells = max(64, sum(r.n for r in sources) // cell_rows)
    salt = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(cells)).cast("int")

    def tagged(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan.withColumnRenamed("source", "its")), F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumn("salt", salt)  # a row for each source

    counts = tagged(small).groupBy("s", "size", "salt").agg(F.count("*").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    counts = counts.where("size > 0").withColumn("before", F.sum("n").over(W.partitionBy("s", "size").orderBy("salt")) - F.col("n"))
    counts = checkpoint(counts)
    lengths = counts.groupBy("s", "size").agg(F.sum("n").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        goal, whole = round(float(pdf["target"][0])), int(pdf["source_size"][0])
        passes = min(PASSES, goal // whole)
        extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), goal - passes * whole) if passes < PASSES else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"s": pdf["s"], "size": pdf["size"], "passes": passes, "extra": extra})

    chosen = lengths.groupBy("s").applyInPandas(choose, "s int, size long, passes long, extra long")  # one row for each length of a source
    quota = counts.select("s", "size", "salt", "before", "n").join(chosen, ["s", "size"]).select("s", "size", "salt", "passes", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("more"), "n")
    rows = tagged(keyed if carry else small)
    part = rows.where("size > 0").join(quota, ["s", "size", "salt"])
    order = W.partitionBy("s", "size", "salt").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id")
    number = F.when(F.col("more") == 0, F.lit(False)).when(F.col("more") == F.col("n"), F.lit(True)).otherwise(F.row_number().over(order) <= F.col("more"))
    out = ["id", "size", "source_size", "target", "taken", *(["row"] if carry else [])]
    taken = part.withColumn("taken", F.col("size") * (F.col("passes") + number.cast("long"))).select(out)
    return taken.unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(out)).withColumnRenamed("id", id_col)


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The documents as the mix takes them: each as often as it counts, with all its columns."""
    got = mix(docs, carry=True, **options).where("taken > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select("row.*")
