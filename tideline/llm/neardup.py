"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Weights. A shingle of five words weighs (1 + ln tf) x idf. Document frequencies are counted over all
documents in a count-min sketch: a fixed number of counters, whose error is a fixed share of the
number of documents, so the relative frequency that idf needs is as good at every size. idf falls from
1 for shingles in at most 2^-12 of the documents to `common` for those in all of them; it stays that
near to 1 so that the copies of a large group don't lose their similarity by being many.

Samples. For a shingle, a hash gives r and c ~ Gamma(2, 1) and b ~ U(0, 1) for each of bands x rows
samples; t = floor(ln w / r + b), a = ln c - r (t - b) - r; the least a of a text is its sample, and two
texts have equal samples with a chance of just their weighted Jaccard similarity. Equal bands of
samples make candidates; at similarity 0.8 a pair is missed with a chance of (1 - 0.8^5)^12 < 1 %.

Pairs. Exact copies are one node. Any two nodes of a bucket are compared, known to be connected, or
ruled out by their total weights (see `buckets`); their similarity is computed exactly from the texts.

Defined results: null texts are a class of their own each; texts without words are near only to exact
copies; a class is named by its least id (null where it has none); repeated rows share their class, of
which one row is kept; ties go to the smaller id, and among texts of the same least id to the smaller
digest; an empty table gives an empty result; extra columns of any name are ignored by `classes` and
kept by `keep_one`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .buckets import Refine, Similar, linked
from .common import Tables, bitmap, checkpoint, in_bitmap, slices, small_batches, splitmix
from .shingles import shingles

BANDS, ROWS, SIMILARITY = 12, 5, 0.8
#: Bits of the sketch's width, its depth, and counters in a block that is summed at once.
WIDTH_BITS, DEPTH, BLOCK = 20, 2, 1 << 14
#: Entries of the tables of quantiles from which samples take r, c and b.
_TABLE_BITS = 14


@dataclass
class Weights:
    """idf by sketch counter; a shingle has the largest idf (least frequency) of its counters."""

    idf: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, docs: int, common: float, rare: float = 2.0**-12) -> Weights:
        """counts: (depth, width). What other shingles add to a counter is taken to be its row's median."""
        share = np.maximum(counts - np.median(counts, 1, keepdims=True), 0) / max(docs, 1)
        depth = np.log(np.clip(share, rare, 1)) / np.log(rare)
        return Weights((common + (1 - common) * depth).astype(np.float32))

    def __call__(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        idf = np.max([self.idf[i][p] for i, p in enumerate(_counters(h))], 0)
        return (1 + np.log(times)) * idf.astype(np.float64)


def _counters(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(i * WIDTH_BITS)) & np.uint64((1 << WIDTH_BITS) - 1)).astype(np.int64) for i in range(DEPTH)]


def frequencies(texts: DataFrame, common: float = 0.75, width: int = 5) -> Weights:
    """Document frequencies of the shingles of all texts (one column), as weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros((DEPTH, 1 << WIDTH_BITS), np.int32), 0
        for b in slices(batches):
            docs += len(b) - b.column(0).null_count
            for _, _, s in shingles(b.column(0).to_pylist(), width):
                for i, p in enumerate(_counters(s.hash)):
                    seen[i] += np.bincount(p, minlength=1 << WIDTH_BITS).astype(np.int32)
        if docs:
            parts = [zlib.compress(x.tobytes(), 1) for x in seen.reshape(-1, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([docs] * len(parts), pa.int64())], ["block", "counts", "docs"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs: dict[int, int] = {}
        for b in batches:
            for k, raw, n in zip(*(c.to_pylist() for c in b.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(raw), np.int32).astype(np.int64)
                docs[k] = docs.get(k, 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()), pa.array([docs[k] for k in sums], pa.int64())], ["block", "counts", "docs"])

    schema = "block int, counts binary, docs long"
    blocks = DEPTH * (1 << WIDTH_BITS) // BLOCK
    got = texts.mapInArrow(count, schema).repartition(blocks, "block").mapInArrow(total, schema).collect()  # a fixed number of blocks
    counts = np.zeros((blocks, BLOCK))
    for r in got:
        counts[r.block] += np.frombuffer(bytes(r.counts), np.int64)
    return Weights.of(counts.reshape(DEPTH, -1), got[0].docs if got else 0, common)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b at evenly spread quantiles; Gamma(2, 1) by Newton steps on 1 - (1 + x) e^-x."""
    u = (np.arange(1 << _TABLE_BITS) + 0.5) / (1 << _TABLE_BITS)
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(1e-9, x - np.clip((1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), -1, 1))
    return x, np.log(x), u


def signatures(h: np.ndarray, weight: np.ndarray, first: np.ndarray, samples: int, block: int = 1 << 15) -> np.ndarray:
    """(texts x samples) values that agree with a chance of the similarity; NaN for texts without shingles."""
    r_of, c_of, b_of = _tables_once()
    low = np.uint64((1 << _TABLE_BITS) - 1)
    n = len(first) - 1
    out = np.full((n, samples), np.inf)
    log_w = np.log(weight)
    for a in range(0, len(h), block):
        b = min(len(h), a + block)
        i, j = np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, b, side="left")
        have = np.flatnonzero(np.diff(np.clip(first[i : j + 1], a, b)))
        starts = np.clip(first[i:j], a, b)[have] - a
        part, w = h[a:b], log_w[a:b]
        for k in range(samples):
            u = splitmix(part + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            r, bb = r_of[u & low], b_of[(u >> np.uint64(28)) & low]
            t = np.floor(w / r + bb)
            t -= bb
            t += 1
            t *= r
            v = c_of[(u >> np.uint64(14)) & low]
            v -= t
            out[i + have, k] = np.minimum(out[i + have, k], np.minimum.reduceat(v, starts))
    return out


_made: list = []


def _tables_once() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _made:
        _made.append(_tables())
    return _made[0]


def bands_of(texts: list[str | None], weights: Weights, width: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bands) keys, 0 for texts without words; total weights."""
    out, total = np.zeros((len(texts), bands), np.int64), np.zeros(len(texts))
    for a, b, s in shingles(texts, width):
        w = weights(s.hash, s.times)
        total[a:b] = np.diff(np.append(0.0, np.cumsum(w))[s.first])
        v = signatures(s.hash, w, s.first, bands * rows).view(np.uint64).reshape(b - a, bands, rows)
        key = np.arange(1, bands + 1, dtype=np.uint64)[None, :].repeat(b - a, 0)
        for j in range(rows):
            key = splitmix(key * np.uint64(0xD6E8FEB86659FD93) + v[:, :, j])
        key[np.diff(s.first) == 0] = 0
        out[a:b] = key.view(np.int64)
    return out, total


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - both
    return both / whole if whole > 0 else 0.0


def _weighed(text: str, weights: Weights, width: int) -> tuple[np.ndarray, np.ndarray]:
    (_, _, s), = shingles([text], width)
    order = np.argsort(s.hash)
    return s.hash[order], weights(s.hash, s.times)[order]


def _number(digest: str) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, 12), 16, 10).cast("long")


def _among(wanted: Broadcast) -> Callable[[Column], Column]:
    """Whether a bitmap of numbers of digests has a digest's."""

    @F.pandas_udf("boolean")
    def among(number: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(wanted.value, number.to_numpy(np.int64)))

    return among


def _picked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text once for each wanted node, of digest, text; other texts are mostly left out before the shuffle."""
    kept = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select(_number("node"))))  # a fixed size

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # copies meet in one task; those of a batch and its neighbours go once
        for batch in batches:
            digests = batch.column(0).to_pylist()
            numbers = np.array([int.from_bytes(d[:6], "big") if d else 0 for d in digests], np.int64)
            ok = in_bitmap(kept.value, numbers)
            for i in np.flatnonzero(ok):
                ok[i] = digests[i] is not None and digests[i] not in sent
                sent.add(digests[i])
            if len(sent) > 100_000:
                sent.clear()
            yield batch.filter(pa.array(ok))

    some = texts.select(F.col("digest").alias("node"), "text").mapInArrow(pick, "node binary, text string")
    return some.groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node", "left_semi")


def _prefixes(some: DataFrame, texts: DataFrame, weights: Broadcast, width: int, least: float) -> DataFrame:
    """node, token, before, rest, total for `linked`: shingles of texts (node, text), the rarest first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, w = _weighed(text, weights.value, width)
                order = np.lexsort((h, -weights.value(h, np.ones(len(h)))))
                h, w = h[order], w[order]
                rest = np.cumsum(w[::-1])[::-1]
                n = int((rest >= least * rest[0] - 1e-9).sum()) if len(h) else 0
                tokens = h[:n].view(np.int64)
                before = [tokens[max(0, i - 8) : i] for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([node] * n, pa.binary()), pa.array(tokens), pa.array(before, pa.list_(pa.int64())), pa.array(rest[:n]), pa.array(np.full(n, rest[0] if n else 0.0))], ["node", "token", "before", "rest", "total"])

    return texts.join(some, "node", "left_semi").mapInArrow(cut, "node binary, token long, before array<long>, rest double, total double")


def _similar(pairs: DataFrame, texts: DataFrame, weights: Broadcast, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes and whether their texts (node, text) are `similar`."""
    # The hot end of a star is joined last, where its rows can be split.
    rows = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in slices(batches):
            good = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb"))):
                if a != last:
                    last, known = a, _weighed(ta, weights.value, width)
                good.append(similarity(known, _weighed(tb, weights.value, width)) >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "similar"])

    return rows.mapInArrow(check, "a binary, b binary, similar boolean")


def text_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, common: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(digest, class_id, best, alone) for every distinct non-null text; (id, digest) of every row.

    best: the one digest of its class that is kept; alone: the text is a class of one row.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.unhex(F.md5(f"`{text_col}`")).alias("digest"))
    kind = base.schema["id"].dataType.simpleString()
    weights = spark.sparkContext.broadcast(frequencies(base.select("text"), common, width))  # as large as the sketch, whatever the corpus
    names = [f"k{i}" for i in range(bands)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            alike: dict[str | None, int] = {}
            place = [alike.setdefault(t, len(alike)) for t in texts]
            keys, total = bands_of(list(alike), weights.value, width, bands, rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(total[place]), *[pa.array(np.ascontiguousarray(c)) for c in keys[place].T]], ["id", "digest", "mark", *names])

    signed = base.mapInArrow(sign, f"id {kind}, digest binary, mark double, {', '.join(f'{c} long' for c in names)}")
    signed = checkpoint(signed)  # ids, digests and keys; the texts are not signed again
    nodes = checkpoint(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("times"), F.min("mark").alias("mark"), *[F.min(c).alias(c) for c in names]))
    members = nodes.select(F.col("digest").alias("node"), "mark", F.explode(F.array(*names)).alias("key")).where("key != 0")

    def prepare(some: DataFrame) -> tuple[Similar, Refine]:
        texts = table(_picked(base.select("digest", "text"), some))
        return lambda pairs: _similar(pairs, texts, weights, width, similarity), lambda open_: _prefixes(open_, texts, weights, width, similarity)

    table = Tables(spark)
    roots = linked(members, table, prepare, lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9, similarity)
    found = nodes.select("digest", "first_id", "times").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    of = found.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "digest")).alias("best"), F.sum("times").alias("all"))
    of = found.join(of, "root").select("digest", F.col("best.first_id").alias("class_id"), (F.col("best.digest") == F.col("digest")).alias("best"), (F.col("all") == 1).alias("alone"))
    of = checkpoint(of)
    table.drop()
    return of, signed.select("id", "digest")


def classes(docs: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """id, class_id (the least id of the class), kept (whether the row stands for its class) for every row."""
    with small_batches(docs.sparkSession):
        of, rows = text_classes(docs, id_col=id_col, **options)
    known = rows.join(of.select("digest", "class_id", "best"), "digest", "left")
    stands = F.coalesce(F.col("best") & F.col("id").eqNullSafe(F.col("class_id")), F.lit(False))
    known = checkpoint(known.select("id", "digest", F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.col("best").isNull().alias("no_text"), stands.alias("stands")))
    one = known.where("stands").withColumn("kept", F.row_number().over(W.partitionBy("digest").orderBy("id")) == 1)  # more than one only for repeated rows
    rest = known.where("not stands").withColumn("kept", F.col("no_text"))
    return one.unionByName(rest).select(F.col("id").alias(id_col), "class_id", "kept")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows, with all their columns, that stand for their classes: one each, the one with the least id.

    Rows that are alone in their class are not shuffled; a bitmap of fixed size finds most of them.
    """
    with small_batches(docs.sparkSession):
        of, _ = text_classes(docs, id_col=id_col, text_col=text_col, **options)
    several = of.where("not alone").select(F.col("digest").alias("node"))
    among = _among(docs.sparkSession.sparkContext.broadcast(bitmap(several.select(_number("node")))))
    row, digest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.unhex(F.md5(f"`{text_col}`"))
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), digest.alias("digest"))
    rows = rows.withColumn("doubtful", F.coalesce(among(F.coalesce(_number("digest"), F.lit(0))), F.lit(False)) & F.col("digest").isNotNull())
    best = of.where("best").select("digest", F.col("class_id").alias("id"))
    known = rows.where("doubtful").alias("r").join(best.alias("b"), (F.col("r.digest") == F.col("b.digest")) & F.col("r.id").eqNullSafe(F.col("b.id")))
    one = known.groupBy("r.digest").agg(F.first("row").alias("row"))
    return rows.where("not doubtful").select("row").unionByName(one.select("row")).select("row.*")
