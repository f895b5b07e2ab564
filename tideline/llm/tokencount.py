"""Token counts under a unigram model by dynamic programming over a shared trie.

The best segmentation of a pre-token is found character by character: the best score of a prefix is
the maximum, over the pieces that end there, of the piece's score and the best score of the prefix
before it. Distinct pre-tokens stand in a trie, so a prefix that many share is scored once; its node
keeps the best scores and the numbers of tokens of all prefixes on its path, and a terminal keeps its
pre-token's number of tokens.

A pre-token is a run of blanks with what follows it up to the next blank, or a piece of that between
characters that stand in no piece of two or more characters. As no piece has a blank behind another
character, segmentations of pre-tokens put together are the best one of the whole text.

The model is read from a SentencePiece file whose path is a parameter. Pieces of a unigram model keep
their scores. A BPE model has no probabilities but ranks (as negative scores); its pieces get the
logarithms of Zipf's law, -ln(2 + rank), user-defined pieces that of the last rank. A character without a piece costs `unknown` (10 less than the least score) and counts as its UTF-8
bytes where the model falls back to bytes, else as one token.

Defined results: null and empty texts have 0 tokens; of equally good segmentations the one whose last
piece is longer counts; repeated rows are counted each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Trie nodes that a task keeps; beyond them it starts anew, which changes no count.
MAX_NODES = 2_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[i : i + n]
            i += n


@dataclass
class Unigram:
    """Pieces with their scores; `bytewise`: characters without a piece count as their bytes."""

    scores: dict[str, float]
    bytewise: bool = True
    unknown: float = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        bad = [p for p in self.scores if BLANK in p.lstrip(BLANK)]
        if bad:
            raise ValueError(f"pieces with blanks inside: {bad[:3]}")
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.longest = max(map(len, self.scores), default=1)
        inside = sorted({c for p in self.scores if len(p) > 1 for c in p} - {BLANK})
        letters = "".join(map(re.escape, inside)) or "(?!)"
        self.pretokens = re.compile(f"{BLANK}*[{letters}]+|{BLANK}+|[^{BLANK}]" if inside else f"{BLANK}+|[^{BLANK}]")

    @staticmethod
    def read(raw: bytes) -> Unigram:
        """From the content of a SentencePiece model file: its normal and user-defined pieces."""
        scores, bytewise, ranked = {}, False, False
        for k, piece in _fields(raw):
            if k == 2:
                ranked = dict(_fields(piece)).get(3, 1) == 2
            if k == 1:
                x = dict(_fields(piece))
                if x.get(3, 1) in (1, 4):
                    scores[x[1].decode()] = struct.unpack("<f", x[2])[0] if 2 in x else 0.0
                bytewise |= x.get(3) == 6
        if ranked:
            scores = {p: -math.log(2 + min(len(scores), max(0.0, -s))) for p, s in scores.items()}
        return Unigram(scores, bytewise)


class Trie:
    """Pre-tokens of one task. A node: its children, and best score and tokens of each prefix of its path."""

    def __init__(self, model: Unigram, most: int = MAX_NODES) -> None:
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens, self.parent = [0.0], [0], [-1]
        self.terminal: dict[str, int] = {}

    def count(self, token: str) -> int:
        """Tokens of a pre-token, from its terminal or by walking and growing the trie."""
        known = self.terminal.get(token)
        if known is not None:
            return known
        if len(self.best) > self.most:
            self.clear()
        node, child, scores = 0, self.child, self.model.scores
        best, tokens, parent, longest = self.best, self.tokens, self.parent, self.model.longest
        for i, c in enumerate(token, 1):
            at = child.get((node, c))
            if at is None:
                before, top, n = node, None, 0
                for j in range(i - 1, max(-1, i - 1 - longest), -1):
                    score = scores.get(token[j:i])
                    if score is None and j == i - 1:
                        score = self.model.unknown
                        extra = len(c.encode("utf-8", "surrogatepass")) if self.model.bytewise else 1
                    else:
                        extra = 1
                    if score is not None and (top is None or best[before] + score >= top):
                        top, n = best[before] + score, tokens[before] + extra
                    before = parent[before]
                at = child[node, c] = len(best)
                best.append(top)
                tokens.append(n)
                parent.append(node)
            node = at
        self.terminal[token] = tokens[node]
        return tokens[node]

    def total(self, text: str | None) -> int:
        """Tokens of a text: blanks become pieces' blanks, and one stands before the text."""
        if not text:
            return 0
        known, count = self.terminal, self.count
        return sum([known[t] if t in known else count(t) for t in self.model.pretokens.findall(BLANK + text.replace(" ", BLANK))])


def count(docs: DataFrame, model: Unigram, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens for every row. No shuffle: each task has a trie of its own, of bounded size."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(kept.value)
        for b in batches:
            n = [trie.total(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long")
