"""Language identification with bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of the n-grams that it contains. The filters share their hash functions and
are stored bit-sliced: slot p holds a mask with one bit for each language, so the AND of an n-gram's
k slots is the set of *all* languages whose filter has it. For a text, the set bits are counted per
language; with n looked-up n-grams and a filter's false-positive rate f, c = (hits - n f) / (1 - f)
is the number of true hits to be expected. The language with most corrected hits wins.

Training: a sample of labelled rows that is bounded by `train_docs` rows (in expectation) for each
language, picked by a hash of the id. Prediction covers every row and its whole text.

Defined results: null texts and texts without a letter get `und` and score 0; ties go to the language
with more training rows, then to the smaller name; with no trained language all texts get `und`; an
empty table gives an empty result; extra columns are ignored; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, splitmix

ORDERS = (1, 2, 3, 4)
#: Characters that are handled at once; longer texts are cut at a blank.
CHUNK = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a blank."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[[not chr(i).isalpha() for i in range(0x110000)]] = 32
    return out


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the hashes of all n-grams of the texts in a row, and where each text's begin and end.

    A text is its lower-cased letters, other characters read as one blank between and around them.
    """
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(f" {' '.join(lower)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[codes]
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.cumsum(keep) - 1
    size = np.array([len(t) for t in lower])
    first = np.cumsum(size + 1) - size  # of the text, behind a blank
    begin, end = at[first - 1], at[first + size]  # the blanks around it
    codes = codes[keep].astype(np.uint64)
    h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            yield n, splitmix(h), begin, np.maximum(begin, end - n + 2)


def _pieces(text: str) -> list[str]:
    """The text in pieces of at most CHUNK characters, cut behind blanks where there are some."""
    out, i = [], 0
    while len(text) - i > CHUNK:
        j = text.rfind(" ", i + 1, i + CHUNK) + 1 or i + CHUNK
        out.append(text[i:j])
        i = j
    return [*out, text[i:]]


@dataclass
class LangFilter:
    """Bit-sliced Bloom filters: `slots[w, p]` holds the bits of languages 64 w .. 64 w + 63."""

    langs: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    k: int

    @staticmethod
    def build(langs: list[str], grams: list[np.ndarray], bits: int = 17, k: int = 3) -> LangFilter:
        """grams: for each language the n-gram hashes that its filter takes."""
        kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= n), np.uint64)
        slots = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), kind)
        rate = np.zeros(len(langs))
        for i, h in enumerate(grams):
            one = np.zeros(1 << bits, bool)
            for p in _places(h, bits, k):
                one[p] = True
            slots[i // 64] |= one.astype(kind) << kind(i % 64)
            rate[i] = one.mean() ** k
        return LangFilter(langs, slots, rate, k)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits (texts x languages) and the number of letters-and-blanks n-grams of each text."""
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        bits = int(self.slots.shape[1]).bit_length() - 1
        for _, h, begin, end in _grams(texts):
            places = _places(h, bits, self.k)
            n = end - begin
            total += n
            for w, slots in enumerate(self.slots):
                mask = slots[places[0]]
                for p in places[1:]:
                    mask &= slots[p]
                for i in range(64 * w, min(len(self.langs), 64 * w + 64)):
                    sums = np.zeros(len(mask) + 1, np.int64)
                    np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), out=sums[1:])
                    hits[:, i] += sums[np.minimum(end, len(mask))] - sums[np.minimum(begin, len(mask))]
        return hits, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        owner, parts = [], []
        for i, t in enumerate(texts):
            for piece in _pieces(t) if t else []:
                owner.append(i)
                parts.append(piece)
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for a, b in chunks(map(len, parts), CHUNK):
            h, n = self.counts(parts[a:b])
            np.add.at(hits, owner[a:b], h)
            np.add.at(total, owner[a:b], n)
        true = np.maximum(0, hits - total[:, None] * self.false_rate) / (1 - self.false_rate)
        known = total > 1  # a text without a letter is one blank
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = true.argmax(1)
        share = np.square(true)
        whole = share.sum(1)
        score = np.where(whole > 0, share.max(1) / np.where(whole > 0, whole, 1), 1 / len(self.langs))
        return [self.langs[i] if k else "und" for i, k in zip(best, known)], np.where(known, score, 0.0)


def _places(h: np.ndarray, bits: int, k: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int32) for i in range(k)]


def train(docs: DataFrame, usable: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 2000, min_share: float = 1e-4, bits: int = 18) -> LangFilter:
    """Learn a LangFilter from labelled rows.

    About `train_docs` rows of each language (all, if fewer) are used, chosen by a hash of the id. A
    language contains the n-grams with at least `min_share` of its n-grams of their order, so at most
    1 / min_share of each order come to the driver; its filter takes all of these, whatever other
    languages contain.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (usable if usable is not None else F.lit(True)).alias("use")).where("use and lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return LangFilter([], np.zeros((1, 1 << bits), np.uint8), np.zeros(0), 3)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))])
    picked = rows.where((F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[np.ndarray]] = {}

        def merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([p[1] for p in pairs])).astype(np.int64)

        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).extend(_pieces(text))
            for lang, parts in by.items():
                for a, b in chunks(map(len, parts), CHUNK):
                    for n, h, begin, end in _grams(parts[a:b]):
                        use = np.zeros(len(h) + 1, np.int64)
                        np.add.at(use, np.minimum(begin, len(h)), 1)
                        np.add.at(use, np.minimum(end, len(h)), -1)
                        keys, times = np.unique(h[np.cumsum(use)[:-1] > 0], return_counts=True)
                        held = seen.setdefault((lang, n), [])
                        held.append((keys, times.astype(np.int64)))
                        if len(held) > 8:
                            seen[lang, n] = [merged(held)]
        for (lang, n), held in seen.items():
            keys, times = merged(held)
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(np.full(len(k), n, np.int32)), pa.array(k), pa.array(times[i : i + (1 << 16)])], ["lang", "n", "gram", "times"])

    counted = picked.select("text", "lang").mapInArrow(count, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    total = counted.groupBy("lang", "n").agg(F.sum("times").alias("total"))
    shared = counted.join(F.broadcast(total), ["lang", "n"]).withColumn("share", F.col("times") / F.col("total"))  # one row for each language and order
    typical = shared.where(F.col("share") >= min_share).select("lang", "n", "gram", "share").toPandas()
    return LangFilter.build(langs, [typical.loc[typical["lang"] == x, "gram"].to_numpy(np.int64).view(np.uint64) for x in langs], bits)


def predict(docs: DataFrame, model: LangFilter, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits masks, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = kept.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
