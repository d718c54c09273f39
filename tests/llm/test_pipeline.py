import corpus_pipeline
from pressroom.llm.common import read

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = read(spark, DATA, "documents")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        assert docs.count() <= count
        count = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == count > 0
