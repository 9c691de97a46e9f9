"""The pipeline against a plain version of its decisions."""

import corpus_pipeline
from lodestone.llm import quality
from lodestone.llm.shared import cut

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, labels)
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    one = cut(corpus_pipeline.STAGES[0][1](spark, docs, SF), "test")
    assert {r.doc_id for r in one.collect()} == good and one.columns == names
    comp = brute.jaccard([(i, rows[i]) for i in good], 5, 80, 100)
    want = {i for i in good if comp[i][1] == i}
    two = cut(corpus_pipeline.STAGES[1][1](spark, one, SF), "test")
    assert sorted(r.doc_id for r in two.collect()) == sorted(want) and two.columns == names
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, v in brute.contamination([(i, rows[i]) for i in want], items).items() if v[4]}
    three = cut(corpus_pipeline.STAGES[2][1](spark, two, SF), "test")
    assert {r.doc_id for r in three.collect()} == want - dirty and three.columns == names
    four = cut(corpus_pipeline.STAGES[3][1](spark, three, SF), "test")
    assert four.columns == names and {r.doc_id for r in four.collect()} == want - dirty
    last = corpus_pipeline.STAGES[4][1](spark, four, SF).collect()
    assert {r.doc_id for r in last} == want - dirty
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in last)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), f"test-{name}")
    assert docs.count() == 0
