"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

A text's words run through the automaton; at each word it knows the longest suffix of what was read
that occurs in some item. Where that length reaches `window` words, the last `window` words are a
window of an item and are hit; an item of fewer words (but not none) is one window as a whole.
Suffix links lead from a match to the items that share the window.

An automaton is built on the driver over at most `max_words` item words and broadcast; a larger
benchmark gets several, through which the rows pass one behind the other, without a shuffle.

Defined results: null texts have no words and no hits; items that are null or without words hold no
window; an item with a null id hits words but is not listed; items with equal ids count once; repeated
rows are judged each; an empty benchmark or table gives no hits or an empty result; extra columns
are ignored by `mark` and kept by `drop` and `clean`. `drop` removes rows past the limit of coverage,
`clean` also cuts spans past the limit of length out of the rows that stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, slices, words_of

WINDOW = 13
#: Item words in one automaton; it has at most twice as many states, each a small dict.
MAX_WORDS = 100_000
Spans = list[tuple[int, int]]


class Automaton:
    """Suffix automaton of all items: `step[s]` maps word numbers to states, `link[s]` is the suffix link."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.number = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = []
        for name, words in items:
            if words:
                rows.append((name, [self.number.setdefault(w, len(self.number)) for w in words]))
        for _, ids in rows:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        # full[s]: the state among s and its suffixes that holds the suffix of `window` words.
        self.full = [-1] * len(self.link)
        for s in order:
            up = self.link[s]
            self.full[s] = self.full[up] if self.length[up] >= window else s if self.length[s] >= window else -1
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, dict[int, set[str | None]]] = {}
        for name, ids in rows:
            s = 0
            for w in ids:
                s = self.step[s][w]
                if self.full[s] >= 0:
                    self.items.setdefault(self.full[s], set()).add(name)
            if len(ids) < window:
                while self.length[self.link[s]] >= len(ids):
                    s = self.link[s]
                self.short.setdefault(s, {}).setdefault(len(ids), set()).add(name)
        # near[s]: the first of s and its suffixes that holds a whole short item.
        self.near = [-1] * len(self.link)
        for s in order:
            self.near[s] = s if s in self.short else self.near[self.link[s]]
        self.least = min([window, *(n for x in self.short.values() for n in x)])

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the strings of q that end p's words by w; q itself if it holds no longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if (q := self.step[last].get(w)) is not None:  # another item began like this
            return self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.step[p][w])
        return new

    def scan(self, words: list[bytes]) -> tuple[Spans, set[str | None]]:
        """Merged spans [from, to) of hit words, and the items with windows in them."""
        if len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        known = np.zeros(len(ids) + 2, np.int8)
        known[1:-1] = ids >= 0
        turns = np.flatnonzero(np.diff(known))
        spans: Spans = []
        found: set[str | None] = set()
        step, link, length, full, near, window = self.step, self.link, self.length, self.full, self.near, self.window
        for a, b in turns.reshape(-1, 2)[turns[1::2] - turns[::2] >= self.least].tolist():
            s = n = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                t = step[s].get(w)
                while t is None:
                    s = link[s]
                    if s < 0:
                        break
                    n = length[s]
                    t = step[s].get(w)
                if t is None:
                    s = n = 0
                    continue
                s, n = t, n + 1
                hit = 0
                if n >= window:
                    hit = window
                    found |= self.items[full[s]]
                u = near[s]
                while u >= 0:
                    for m, names in self.short[u].items():
                        if m <= n:
                            hit = max(hit, m)
                            found |= names
                    u = near[link[u]]
                if hit:
                    start = i - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


def merged(a: Spans, b: Spans) -> Spans:
    out: Spans = []
    for x, y in sorted([*a, *b]):
        if out and out[-1][1] >= x:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def build(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> list[Broadcast]:
    """Broadcast automata over the items, each of at most `max_words` words (or of one longer item)."""
    out, rows, held = [], [], 0
    share = items.sparkSession.sparkContext.broadcast
    for r in items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        words = words_of(r.text)
        if rows and held + len(words) > max_words:
            out.append(share(Automaton(rows, window)))
            rows, held = [], 0
        rows.append((r.id, words))
        held += len(words)
    return [*out, share(Automaton(rows, window))]


_MARKS = [pa.field("n_words", pa.int64()), pa.field("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.field("items", pa.list_(pa.string()))]


def mark(docs: DataFrame, automata: list[Broadcast], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, spans array<struct<from, to>> (of words), items array<string> for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    for k, automaton in enumerate(automata):

        def run(batches: Iterator[pa.RecordBatch], kept: Broadcast = automaton, first: bool = not k, last: bool = k == len(automata) - 1) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                n, spans, items = [], [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    words = words_of(text)
                    got, names = kept.value.scan(words)
                    names.discard(None)
                    if not first:
                        got = merged(got, [(x["from"], x["to"]) for x in b.column("spans")[i].as_py()])
                        names.update(b.column("items")[i].as_py())
                    n.append(len(words))
                    spans.append([{"from": x, "to": y} for x, y in got])
                    items.append(sorted(names))
                made = [pa.array(x, f.type) for x, f in zip((n, spans, items), _MARKS)]
                yield pa.RecordBatch.from_arrays([b.column("id"), *([] if last else [b.column("text")]), *made], ["id", *([] if last else ["text"]), "n_words", "spans", "items"])

        rows = rows.mapInArrow(run, f"id {kind}, {'' if k == len(automata) - 1 else 'text string, '}n_words long, spans array<struct<`from`:long,`to`:long>>, items array<string>")
    return rows.withColumnRenamed("id", id_col)


def contaminated(n_words: int, spans: Spans, coverage: float = 0.05) -> bool:
    hit = sum(y - x for x, y in spans)
    return hit > 0 and hit >= coverage * n_words


def drop(docs: DataFrame, automata: list[Broadcast], *, text_col: str = "text", coverage: float = 0.05) -> DataFrame:
    """The rows, with all their columns, in which less than `coverage` of the words are hit."""
    at = docs.columns.index(text_col)
    for automaton in automata if len(automata) == 1 else []:

        def run(batches: Iterator[pa.RecordBatch], kept: Broadcast = automaton) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                good = []
                for text in b.column(at).to_pylist():
                    words = words_of(text)
                    good.append(not contaminated(len(words), kept.value.scan(words)[0], coverage))
                yield b.filter(pa.array(good, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return mark(whole, automata, id_col="row").where((hit == 0) | (hit < coverage * F.col("n_words"))).select("row.*")


def clean(docs: DataFrame, automata: list[Broadcast], *, text_col: str = "text", coverage: float = 0.05, length: int = WINDOW) -> DataFrame:
    """The rows that `drop` keeps, with all their columns; spans of at least `length` words are cut out of their texts."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good, texts = [], []
            for text in b.column(at).to_pylist():
                words, spans = words_of(text), []
                for automaton in automata:
                    spans = merged(spans, automaton.value.scan(words)[0])
                good.append(not contaminated(len(words), spans, coverage))
                texts.append(without_spans(text, [s for s in spans if s[1] - s[0] >= length]) if good[-1] else None)
            field = b.schema.field(at)
            yield b.set_column(at, field, pa.array(texts, field.type)).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without_spans(text: str, spans: Spans) -> str:
    """The text without its hit words and what stands between them within a span."""
    if not spans:
        return text
    raw = text.encode()
    plain, at, places = raw.translate(WORD_TABLE), 0, []
    for w in plain.split():
        at = plain.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for x, y in spans:
        out.append(raw[last : places[x][0]])
        last = places[y - 1][1]
    return b"".join([*out, raw[last:]]).decode()
