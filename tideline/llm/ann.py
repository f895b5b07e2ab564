"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards by a hash of their ids. A shard's graph is kept as flat neighbour
arrays: `links[level]` is a matrix (nodes of the level x degree) of node numbers, -1 where there are
fewer. Levels thin out by a factor of `degree`, and a level holds all nodes of those above it. Nodes
are inserted in blocks in a random order: a block descends from the top level, searches the graph so
far for its nearest nodes, and is compared within itself; of these candidates those are linked that
are nearer to the node than to any neighbour linked before. Links go both ways; a node keeps its
nearest ones.

Inner products are searched among vectors of any length: the graph is built on vectors lengthened by
one component to a common norm, where the nearest by angle are those with the largest products.
Queries go down the levels in blocks, with a beam of `beam` nodes in each. The nodes found are
scored anew in double precision, and the shards' best are merged.

Equal vectors of a shard are one node with the smallest `k + 1` of their ids, which is all that a
list of the k nearest other rows can show of them; so copies never crowd out the graph.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; rows
with null ids neither; vectors of each dimension are searched among themselves; rows of the same id
and vector are one query, for which all but one of them are candidates, and so are rows of the same id
with other vectors, which are queries of their own; with fewer candidates than k all are returned; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows in a shard, about, and the fewest shards.
SHARD_ROWS, LEAST_SHARDS = 16_384, 8


@dataclass
class Graph:
    """nodes: distinct vectors. links[l]: neighbours on level l by row; members[l]: the level's nodes, top level last."""

    nodes: np.ndarray
    members: list[np.ndarray]
    links: list[np.ndarray]

    @staticmethod
    def build(x: np.ndarray, degree: int = 16, pool: int = 48, seed: int = 42) -> Graph:
        """x: distinct vectors. Level 0 has 2 x degree links a node, the others `degree`."""
        sq = (x.astype(np.float64) ** 2).sum(1)
        rest = np.sqrt(np.maximum(0, sq.max(initial=0) - sq))
        y = np.hstack([x, rest[:, None]]).astype(np.float32)
        y /= max(float(np.sqrt(sq.max(initial=0))), 1e-30)
        order = np.random.default_rng(seed).permutation(len(x))
        sizes = [len(x)]
        while sizes[-1] > 2 * degree:
            sizes.append(max(1, sizes[-1] // degree))
        above = Graph(y, [], [])  # levels from the top; searched on the lengthened vectors
        for level, n in reversed(list(enumerate(sizes))):
            here = order[:n]
            links = above._grown(here, degree if level else 2 * degree, pool, sizes[level + 1] if level + 1 < len(sizes) else 0)
            above.members.insert(0, here)
            above.links.insert(0, links)
        return Graph(x.astype(np.float32), above.members, above.links)

    def _grown(self, here: np.ndarray, degree: int, pool: int, known: int, block: int = 1024) -> np.ndarray:
        """Links of the nodes `here` in the order of their insertion, the first `known` of which are the level above."""
        y, n = self.nodes, len(here)
        links = np.full((n, degree), -1)
        row = np.full(len(y) + 1, -1, np.int64)
        done = min(n, max(2 * degree, 1))
        row[here[:done]] = np.arange(done)
        near, _ = _nearest(y[here[:done]], pool)
        _link(y, here, row, links, np.arange(done), here[near] if near.size else np.full((done, 0), -1))
        while done < n:
            end = min(n, done + min(done, block))
            new = here[done:end]
            start = self.search(y[new], 8)[0] if self.links else np.broadcast_to(here[None, :1], (len(new), 1))
            start = np.where((start >= 0) & (row[start] >= 0), start, -1)  # of the level above, those that are already here
            start = np.concatenate([start, np.broadcast_to(here[None, :4], (len(new), min(4, done)))], 1)
            found, score = self._walk(y[new], _once(start), links, row, pool)
            near, close = _nearest(y[new], pool)
            row[new] = np.arange(done, end)
            both, scores = np.concatenate([found, new[near]], 1), np.concatenate([score, close], 1)
            at = np.argsort(-scores, 1, kind="stable")[:, :pool]
            _link(y, here, row, links, np.arange(done, end), np.take_along_axis(both, at, 1))
            done = end
        return links

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers (-1: none) and products of the `beam` best nodes for each query, best first."""
        q = q.astype(np.float32)
        top = self.members[-1]
        entry = np.broadcast_to(top[None, :], (len(q), len(top)))
        for level in range(len(self.links) - 1, -1, -1):
            row = np.full(len(self.nodes) + 1, -1, np.int64)
            row[self.members[level]] = np.arange(len(self.members[level]))
            entry, score = self._walk(q, entry, self.links[level], row, beam if not level else max(8, beam // 4))
        return entry, score

    def _walk(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, row: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on one level for all queries at once; in each step every query opens its best unopened node."""
        n, none = len(q), len(self.nodes)
        width = beam + links.shape[1]
        found = np.full((n, max(beam, entry.shape[1])), none)
        found[:, : entry.shape[1]] = np.where(entry < 0, none, entry)
        score = np.where(found < none, np.einsum("qd,qkd->qk", q, self.nodes[np.minimum(found, none - 1)]), -np.inf).astype(np.float32)
        if found.shape[1] > beam:
            at = np.argpartition(-score, beam - 1, 1)[:, :beam]
            found, score = np.take_along_axis(found, at, 1), np.take_along_axis(score, at, 1)
        seen = np.zeros((n, none + 1), bool)
        seen[:, none] = True
        np.put_along_axis(seen, found, True, 1)
        opened = found == none
        live = np.arange(n)
        while len(live):
            pick = np.where(opened[live], -np.inf, score[live]).argmax(1)
            more = ~opened[live, pick]
            live, pick = live[more], pick[more]
            if not len(live):
                break
            opened[live, pick] = True
            near = links[row[found[live, pick]]]
            near = np.where(near < 0, none, near)
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            product = np.einsum("qd,qkd->qk", q[live], self.nodes[np.where(fresh, near, 0)])
            product[~fresh] = -np.inf
            both = np.concatenate([score[live], product], 1)
            at = np.argpartition(-both, beam - 1, 1)[:, :beam] if both.shape[1] > beam else np.broadcast_to(np.arange(width)[None], both.shape)
            ids = np.concatenate([found[live], np.where(fresh, near, none)], 1)
            done = np.concatenate([opened[live], ~fresh], 1)
            found[live], score[live], opened[live] = (np.take_along_axis(a, at, 1) for a in (ids, both, done))
        at = np.argsort(-score, 1, kind="stable")
        found, score = np.take_along_axis(found, at, 1), np.take_along_axis(score, at, 1)
        return np.where(found == none, -1, found), score


def _once(entry: np.ndarray) -> np.ndarray:
    """Each row's node numbers once; -1 in place of the others."""
    entry = np.sort(entry, 1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    return entry


def _nearest(y: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block the numbers and products of its `pool` nearest other rows, the nearest first."""
    pool = min(pool, len(y) - 1)
    p = y @ y.T
    np.fill_diagonal(p, -np.inf)
    at = np.argpartition(-p, pool - 1, 1)[:, :pool] if pool > 0 else np.zeros((len(y), 0), np.int64)
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(p, at, 1), 1, kind="stable"), 1)
    return at, np.take_along_axis(p, at, 1)


def _link(y: np.ndarray, here: np.ndarray, row: np.ndarray, links: np.ndarray, rows: np.ndarray, near: np.ndarray) -> None:
    """Link the nodes in `rows` to a diverse choice of their candidates `near` (-1: none), the nearest first, and back."""
    degree, pool = links.shape[1], near.shape[1]
    if not pool:
        return
    chosen = np.zeros(near.shape, bool)
    for a in range(0, len(rows), 512):
        z = y[near[a : a + 512]]
        own = np.einsum("nd,npd->np", y[here[rows[a : a + 512]]], z)
        among = np.matmul(z, z.transpose(0, 2, 1))
        pick, there = chosen[a : a + 512], near[a : a + 512] >= 0
        for i in range(pool):
            pick[:, i] = there[:, i] & ~((among[:, i, :i] > own[:, i, None]) & pick[:, :i]).any(1) & (pick.sum(1) < degree)
    # Fill up with the nearest that were left out, so that dense places stay reachable.
    for i in range(pool):
        chosen[:, i] |= (near[:, i] >= 0) & (chosen.sum(1) < degree // 2)
    i, j = np.nonzero(chosen)
    src, dst = rows[i], row[near[i, j]]
    touched = np.unique(np.concatenate([src, dst]))
    old_src, old = np.nonzero(links[touched] >= 0)
    old_dst = row[links[touched][old_src, old]]
    pairs = np.unique(np.concatenate([src * len(here) + dst, dst * len(here) + src, touched[old_src] * len(here) + old_dst]))
    src, dst = pairs // len(here), pairs % len(here)
    close = np.concatenate([np.einsum("nd,nd->n", y[here[src[a : a + 65536]]], y[here[dst[a : a + 65536]]]) for a in range(0, len(src), 65536)])
    order = np.lexsort((-close, src))
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    ok = place < degree
    links[touched] = -1
    links[src[ok], place[ok]] = here[dst[ok]]


def search(vectors: DataFrame, query: Column, *, k: int = 20, beam: int = 128, degree: int = 16, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS, block: int = 512, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that `query` picks their k nearest other rows.

    Every row is in a graph and every query meets every shard, in blocks; queries are shuffled, not
    broadcast, as their number may grow with the table.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(good).withColumn("d", F.size("v"))
    shards = F.greatest(F.lit(least_shards), F.ceil(F.count("*") / shard_rows)).cast("int")
    rows = rows.join(rows.groupBy("d").agg(shards.alias("shards")), "d")  # a row for each dimension
    place = lambda shard: (F.col("d").cast("long") * (1 << 32) + shard).alias("place")  # noqa: E731  a shard of a dimension
    base = rows.select(place(F.pmod(F.xxhash64("id", "v"), "shards")), "id", "v")
    asked = rows.where("q").dropDuplicates(["id", "v"]).select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    asked = asked.select(place(F.col("shard")), F.col("id").alias("id"), F.col("v").alias("v"), F.xxhash64("v").alias("query"))

    def meet(key: tuple[int], own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = {"query_id": "int64", "query": "int64", "vec_id": "int64", "score": "float64"}
        if not len(own) or not len(ask):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in names.items()})
        own, ask = own.sort_values("id", kind="stable"), ask.sort_values("id", kind="stable")
        x, ids = np.array(own["v"].tolist()), own["id"].to_numpy()
        _, first, node = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(node, kind="stable")  # ids ascend within a node
        by = by[np.arange(len(by)) - np.searchsorted(node[by], node[by]) <= k]
        start = np.searchsorted(node[by], np.arange(len(first) + 1))
        graph = Graph.build(x[first], degree)
        q, q_ids, number = np.array(ask["v"].tolist()), ask["id"].to_numpy(), ask["query"].to_numpy()
        out = []
        for a in range(0, len(q), block):
            found, _ = graph.search(q[a : a + block], max(beam, k + 1))
            row, col = np.nonzero(found >= 0)
            hit = found[row, col]
            times = start[hit + 1] - start[hit]
            row, pos = np.repeat(row, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[hit], times)
            cand = by[pos]
            score = np.einsum("nd,nd->n", q[a : a + block][row], x[cand])
            order = np.lexsort((ids[cand], -score, row))
            row, cand, score = row[order], cand[order], score[order]
            own_row = (ids[cand] == q_ids[a + row]) & (x[cand] == q[a + row]).all(1)
            own_row[1:] &= ~((row[1:] == row[:-1]) & own_row[:-1])  # of repeated rows, which lie side by side, one is the query's own
            row, cand, score = row[~own_row], cand[~own_row], score[~own_row]
            ok = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"query_id": q_ids[a + row[ok]], "query": number[a + row[ok]], "vec_id": ids[cand[ok]], "score": score[ok]}))
        return pd.concat(out)

    found = base.groupBy("place").cogroup(asked.groupBy("place")).applyInPandas(meet, "query_id long, query long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
