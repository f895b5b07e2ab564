"""Links within buckets, on nodes whose sets are written out."""

from pyspark.sql import functions as F

from tideline.llm.buckets import linked
from tideline.llm.common import Tables


def test_nodes_that_have_their_first_token_in_common_are_compared(spark):
    # 1 leads all buckets and is like no other node; 2 and 3 are alike, and nothing stands before their common token.
    sets = {1: [(90, 1.0)], 2: [(50, 2.0), (51, 1.0)], 3: [(50, 2.0), (51, 1.0)], 4: [(50, 0.1), (60, 3.0)]}
    members = spark.createDataFrame([*((k, n, 3.0) for k in (7, 8) for n in sets), *((9, n, 3.0) for n in (1, 5))], "key long, node long, mark double")
    rows = []
    for n, tokens in sets.items():
        total = sum(w for _, w in tokens)
        for i, (t, _) in enumerate(tokens):
            rows.append((n, t, [x for x, _ in tokens[:i]], sum(w for _, w in tokens[i:]), total))
    refined = spark.createDataFrame(rows, "node long, token long, before array<long>, rest double, total double")
    tables = Tables(spark)

    def prepare(some):
        return lambda pairs: pairs.withColumn("similar", (F.col("a") == 2) & (F.col("b") == 3)), lambda open_: refined.join(open_, "node", "left_semi")

    got = linked(members, tables, prepare, lambda a, b: F.lit(True), 0.8)
    assert {(r.node, r.root) for r in got.collect()} == {(2, 2), (3, 2)}
    tables.drop()
