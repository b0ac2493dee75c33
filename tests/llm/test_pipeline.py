import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import brute
from vellumspark.llm import mixing, quality, queries


def test_pipeline_equals_plain_steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.fitted(spark, docs, sf)
    keep = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = [(i, rows[i].text) for i in sorted(keep)]
    lines = {i: v[2] for i, v in brute.lines(kept).items() if v[1] < v[0] or not v[1]}
    firsts = [(i, lines[i]) for i, v in brute.near(list(lines.items()), 5, 80).items() if v[2]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i: brute.cut_spans(t, v[3]) for (i, t), v in zip(firsts, brute.contamination(firsts, items).values())}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in out} == clean
    assert all(r.n_chars == len(r.text) for r in out)
    frame = spark.createDataFrame([(i, t, rows[i].source) for i, t in clean.items()], "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.epoch, r.block) for r in mixing.mix(frame).collect())
    assert sorted((r.doc_id, r.epoch, r.block) for r in out) == want


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf).count() == 0
    odd = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text"))).withColumn("source", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        null = out.where("text is null").count()
        assert out.count() > 0 and (null > 0 or name == "quality_classifier"), name
    mixed = corpus_pipeline.source_mixing(spark, odd, sf)
    # One source of all rows: one pass of each document, null texts among them with no tokens.
    assert mixed.count() == odd.count() and mixed.where("text is null and n_tokens = 0").count() == odd.where("text is null").count()
