"""The pipeline's stages, each on all that its predecessor kept."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import entry


def words(rng, n):
    parts = "the ing tion wh th er on and ly ed re st".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    item = words(rng, 30)
    docs, labels = [], []
    for i in range(160):
        kind = i % 8
        text = words(rng, 60)
        if kind == 0:
            text = " ".join(x + "###" for x in text.split())
        if kind == 1 and i > 8:
            text = docs[i - 8][1].replace("the", "the", 1) + " end"
        if kind == 2 and i % 16 == 2:
            text = words(rng, 20) + " " + item
        docs.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((i, int(kind != 0), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    all_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows, ids = all_, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, rows, str(tmp_path))
        if i < 4:
            assert rows.columns == all_.columns, name
            rows.write.parquet(f"{tmp_path}/stage{i}")
            rows = spark.read.parquet(f"{tmp_path}/stage{i}")
        ids.append([r.doc_id for r in rows.select("doc_id").collect()])
    good, one, clean, mixed, shards = ids
    assert sorted(good) == [i for i in range(160) if i % 8]
    assert len(one) == len(set(one)) and set(one) == {i for i in good if not (i % 8 == 1 and i > 1)}
    assert set(clean) == {i for i in one if i % 16 != 2}
    assert set(mixed) <= set(clean) and sorted(shards) == sorted(mixed)
    out = rows
    assert out.agg(F.countDistinct("shard", "slot")).first()[0] == len(shards)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(shards)


def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, words(rng, 40), "en", "a", 1, "r", "d", "n", 2.0) for i in range(40)]
    docs += [(100, None, "en", None, 0, "r", "d", "n", 2.0), (101, "", None, "a", 0, "r", "d", "n", 2.0), (None, words(rng, 30), "en", "a", 0, "r", "d", "n", None), docs[3], docs[3]]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, node string, score double"
    labels = [(i, 1, 0) for i in range(40)] + [(None, 1, 0), (101, None, None)]
    for name, keep in (("odd", len(docs)), ("none", 0)):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(docs[:keep], kind).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels[:keep], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([("i", words(rng, 20)), (None, None)][:keep], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
        rows = spark.read.parquet(f"{d}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, rows, d)
            assert out.columns == rows.columns and [x.dataType for x in out.schema] == [x.dataType for x in rows.schema]
            out.write.parquet(f"{d}/stage{i}")
            rows = spark.read.parquet(f"{d}/stage{i}")
            if name == "odd" and i == 1:
                assert sorted(r.doc_id for r in rows.collect() if r.doc_id is not None and r.doc_id < 100) == list(range(40))  # of repeated rows one stays
                assert all(r.row == "r" and r.digest == "d" and r.node == "n" for r in rows.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, rows, d).count() == rows.count()
        assert (rows.count() > 30) == (name == "odd")


def test_registry():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.QUERIES)
    assert numbers == list(range(1, 11)) and [len(corpus_pipeline.STAGES)] == [5]


def test_few_rows_at_a_time_go_through_python(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def stage(session, docs, sf_dir):
        seen.append(int(session.conf.get(name)))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert seen == [1024, 1024] and spark.conf.get(name) == before
