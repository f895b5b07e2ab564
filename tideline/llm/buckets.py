"""Connected components of similar nodes that share buckets, in rounds of pairs that grow with the members.

Every bucket has a lead, the node most typical of what it holds. First each node is compared with one
of its leads, the most typical of all; what that leaves unconnected is compared with its other leads.
The rest, nodes that their leads did not take in and that share a bucket with nodes of other
components, is dealt anew by `refine` into finer buckets that similar nodes are sure to share. There,
round by round, each bucket elects a lead that is compared with the nodes of other components and then
leaves; once the pairs that are left are no more than a fixed number for each member, they are put to the
bounds at once. So no round meets more pairs than that, no bucket is cut or sampled, and in the end any two
nodes that share a bucket are compared, known to be connected, or ruled out by an exact bound.

Components come from distributed contraction, written each round; only counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Pairs for each member, on average, up to which all that are left are put to the bounds at once.
PAIRS = 64
#: From pairs (a, b) of nodes the same with a column `similar`.
Similar = Callable[[DataFrame], DataFrame]
#: From nodes (node) rows (node, token, before, rest, total), see `linked`.
Refine = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame, table: Tables) -> DataFrame:
    """node, root (the least node of the component) for all nodes of the edges (a, b), written by `table`.

    Each round hooks every root to its least neighbouring root and halves paths until they end at
    roots, so components shrink geometrically and edges within them vanish.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    labels = ends.distinct().withColumn("root", F.col("node"))
    links = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x != y")
    while not links.isEmpty():
        both = links.union(links.select("y", "x"))
        hook = table(both.groupBy("x").agg(F.min("y").alias("y")).where("y < x"))
        while True:  # pointer jumping
            on = hook.alias("h").join(hook.alias("g"), F.col("h.y") == F.col("g.x"), "left")
            new = table(on.select(F.col("h.x").alias("x"), F.coalesce("g.y", "h.y").alias("y"), F.col("g.y").isNotNull().alias("moved")))
            hook = new.select("x", "y")
            if new.where("moved").isEmpty():
                break
        labels = labels.join(hook, labels["root"] == hook["x"], "left").select("node", F.coalesce("y", "root").alias("root"))
        for end in ("x", "y"):
            h = hook.select(F.col("x").alias("from"), F.col("y").alias("to"))
            links = links.join(h, links[end] == h["from"], "left").withColumn(end, F.coalesce("to", end)).drop("from", "to")
        links = table(links.where("x != y").distinct())
    return table(labels)


def rooted(df: DataFrame, roots: DataFrame, col: str, name: str) -> DataFrame:
    """df with the root of its column of nodes, which is the node itself where no edge has it."""
    r = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(r, F.col(col) == F.col("_n"), "left").withColumn(name, F.coalesce("_r", col)).drop("_n", "_r")


def linked(members: DataFrame, table: Tables, prepare: Callable[[DataFrame], tuple[Similar, Refine | None]], near: Callable[[Column, Column], Column], least: float = 0.0) -> DataFrame:
    """node, root of the nodes that are similar to others. members: key, node, mark, each (key, node) once.

    near: an exact bound that similar nodes meet, on their marks. table: keeps
    what is returned and all that is made on the way. prepare: from all nodes (node) that
    share a bucket, what compares and what refines them. Refining gives rows (node, token, before, rest,
    total) of weighted sets in one global order of tokens, `rest` being the weight from a token on and
    `before` the few tokens just before it; only tokens with rest >= least x total. Two sets with a
    Jaccard similarity of `least` have their first common token among those, and overlap by at most the
    smaller rest there; pairs that fall short are not made. Tokens with a common one among those just
    before are not the first, so a pair is made once for each run of common tokens at most. Without
    refining the buckets stay as they are.
    """
    # What many are like lies in large buckets under most of its keys; such a node leads.
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = table(members.join(sizes, "key"))
    rank = shared.groupBy("node").agg((-F.sum(F.log("n"))).alias("rank"))
    similar, refine = prepare(rank.select("node"))
    shared = table(shared.drop("n").join(rank, "node"))
    lead = shared.groupBy("key").agg(F.min(F.struct("rank", "node", "mark")).alias("lead"))
    star = shared.join(lead, "key").where("node != lead.node")
    star = table(star.select("key", "node", "mark", "rank", "lead", near(F.col("mark"), F.col("lead.mark")).alias("near")))

    best = star.where("near").groupBy("node").agg(F.min("lead").alias("lead"))
    tried = table(similar(best.select(F.col("lead.node").alias("a"), F.col("node").alias("b"))))
    roots = components(tried.where("similar"), table)
    led = star.where("near").select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    led = rooted(rooted(led, roots, "a", "_a"), roots, "b", "_b").where("_a != _b").select("a", "b")
    led = table(similar(led))
    tried = tried.union(led)
    if not led.where("similar").isEmpty():
        roots = components(tried.where("similar"), table)

    rest = rooted(star.select("key", "node", "mark", "rank"), roots, "node", "root")
    several = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    rest = table(rest.join(several, "key", "left_semi"))
    if rest.isEmpty():
        return roots
    groups = ["root"]
    if refine:
        tokens = table(refine(rest.select("node").distinct()))
        keys = rest.groupBy("node").agg(F.collect_set("key").alias("keys"))
        rest = rest.withColumnRenamed("key", "own").join(tokens, "node").join(keys, "node")
        rest = rest.withColumn("key", F.xxhash64("own", "token")).drop("token")
        # What stands just before a token; where nothing does, the node itself, as then no two nodes have a token in common.
        rest = rest.withColumn("prev", F.coalesce(F.try_element_at("before", F.lit(-1)), F.xxhash64("node")))
        groups.append("prev")
    while True:
        rest = _open(rest, groups, table)
        count = rest.select(F.sum(F.when(F.col("outside"), F.col("size"))).alias("pairs"), F.count("*").alias("rows")).first()
        if not count["rows"]:
            return roots
        last = (count["pairs"] or 0) <= PAIRS * count["rows"]
        columns = [c for c in rest.columns if c not in ("outside", "size")]
        names = {c: f"{c}_y" for c in columns if c != "key"}
        if last:
            met = rest.where("outside").select(columns).join(rest.select(columns).withColumnsRenamed(names), "key")
        else:
            at = rest.groupBy("key").agg(F.min(F.struct("rank", *[c for c in names if c != "rank"])).alias("y"))
            met = rest.select(columns).join(at, "key").select(*columns, *[F.col(f"y.{c}").alias(n) for c, n in names.items()])
            rest = met.where("node != node_y").select(columns)
        met = met.where(near(F.col("mark"), F.col("mark_y")))
        for c in groups:
            met = met.where(F.col(c) != F.col(f"{c}_y"))
        if refine:
            enough = F.least("rest", "rest_y") >= least / (1 + least) * (F.col("total") + F.col("total_y")) - 1e-9
            first = F.array_min(F.array_intersect("keys", "keys_y")) == F.col("own")  # nodes with several common keys meet under one
            met = met.where(enough & ~F.arrays_overlap("before", "before_y") & first)
        pairs = met.select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct()
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = table(similar(pairs.join(known, ["a", "b"], "left_anti")))
        tried = tried.union(pairs)
        if not pairs.where("similar").isEmpty():
            roots = components(tried.where("similar"), table)
        if last:
            return roots
        rest = table(rooted(rest.drop("root"), roots, "node", "root"))


def _open(rest: DataFrame, groups: list[str], table: Tables) -> DataFrame:
    """The rows of buckets with several values in each column of `groups`, with two more columns.

    Only nodes that differ in all these columns are compared, so one node of each pair is `outside` the
    largest group of its bucket; `size` counts the bucket's rows.
    """
    for c in groups:
        n = rest.groupBy("key", c).agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", c)).alias(f"_{c}"), F.sum("n").alias("size"))
        rest = rest.drop("size").join(n.where(F.col(f"_{c}.n") < F.col("size")), "key")
    outside = F.col(f"_{groups[0]}.{groups[0]}") != F.col(groups[0])
    for c in groups[1:]:
        outside = F.when(F.col(f"_{c}.n") > F.col(f"_{groups[0]}.n"), F.col(f"_{c}.{c}") != F.col(c)).otherwise(outside)
    return table(rest.withColumn("outside", outside).drop(*[f"_{c}" for c in groups]))
