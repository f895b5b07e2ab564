"""Quality classification: histogram gradient-boosted trees over document statistics.

The trees are complete binary trees of one depth, flattened to arrays: node i has children 2i + 1
and 2i + 2, so a whole batch of documents goes down all trees with a few numpy gathers a level.

Training uses a sample of labelled rows bounded by `train_rows` (those with the smallest hashes of
their ids); it is the only part that comes to the driver. Scores cover every row and its whole text.

Defined results: a null text has the statistics of an empty one and is scored like it; with no
labelled rows at all every score is 0.5; labels other than 0 and 1 are left out; a document with two
labels counts with both; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The statistics, in the order of `statistics`.
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "longest_word", "line_words", "distinct_words",
    "distinct_pairs", "distinct_lines", "commonest_word", "upper", "digits", "blanks", "newlines", "marks",
    "symbols", "bars", "exclamations", "periods", "commas", "beyond_ascii", "control", "squeezed", "marked_words",
)
_SYMBOLS = list(b"#$%&*@^~+=<>\\/_{}[]`")
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, w = max(1, len(raw)), max(1, len(words))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    times = Counter(words)
    share = lambda which: float(seen[which].sum()) / n
    pack = zlib.compressobj(1)
    squeezed = sum(len(pack.compress(raw[i : i + (1 << 20)])) for i in range(0, len(raw), 1 << 20)) + len(pack.flush())
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / w, max(map(len, words), default=0), len(words) / max(1, len(lines)),
        len(times) / w, len(set(zip(words, words[1:]))) / max(1, w - 1), len(set(lines)) / max(1, len(lines)), max(times.values(), default=0) / w,
        share(slice(65, 91)), share(slice(48, 58)), share(32), share(10), share(_MARKS), share(_SYMBOLS), share(124), share(33), share(46), share(44),
        share(slice(128, 256)), share(slice(0, 9)), squeezed / n, sum(x[-1] in _SYMBOLS or x[-1] == 33 for x in times) / max(1, len(times)),
    ]


@dataclass
class Trees:
    """`feature` and `cut` (trees x 2^depth - 1), `leaf` (trees x 2^depth); to the right where x > cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        for a in range(0, len(x), 2048):
            rows = x[a : a + 2048]
            node = np.zeros((len(rows), len(self.feature)), np.int64)
            at = np.arange(len(rows))[:, None]
            for _ in range(int(self.leaf.shape[1]).bit_length() - 1):
                node = 2 * node + 1 + (rows[at, self.feature[trees, node]] > self.cut[trees, node])
            out[a : a + 2048] += self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boost trees on the logistic loss; splits are sought over histograms of binned statistics."""
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y):
        return Trees(feature[:0], cut[:0], leaf[:0], 0.0)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)  # x <= edges[b] for bin b
    raw = np.full(len(y), base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                cell = node * bins + binned[:, f]
                gl = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                hl = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                gain = gain[:, : len(edges[f])]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for i in np.flatnonzero(top > best):
                    best[i], feature[t, first + i], cut[t, first + i] = top[i], f, edges[f][at[i]]
            here = first + node
            node = 2 * node + (x[np.arange(len(y)), feature[t, here]] > cut[t, here])
        leaf[t] = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        raw += leaf[t, node]
    return Trees(feature, cut, leaf, base)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 20_000, **options: float) -> Trees:
    """Fit on at most `train_rows` labelled rows. usable: which rows of `labels` may be learnt from."""
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (usable if usable is not None else F.lit(True)))
    ids = ids.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).orderBy(F.xxhash64("id", F.lit("quality")), "id", "label").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # at most train_rows small rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "label", "x"])

    # Several documents may have the id of a label; they share one place in the bound.
    found = rows.select("id", "text", "label").mapInArrow(measure, f"id {ids.schema['id'].dataType.simpleString()}, label double, x array<double>")
    got = found.orderBy(F.xxhash64("id"), "id", "label", "x").limit(train_rows).toPandas()
    return fit(np.array(got["x"].tolist()).reshape(-1, len(STATISTICS)), got["label"].to_numpy(), **options)


def score(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every row."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # trees x 2^depth numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept.value.score(x))], [id_col, "score"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Trees, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score at least `least`."""
    kept, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(kept.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
