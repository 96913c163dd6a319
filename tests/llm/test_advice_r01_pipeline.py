"""The pipeline's first stage without usable labels."""

import corpus_pipeline


def test_no_usable_labels_keep_all(spark, small):
    docs = spark.createDataFrame([(-1, "some text", "en", "s", 9), (-2, None, "en", "s", 0)], spark.read.parquet(f"{small}/documents.parquet").schema)
    assert corpus_pipeline.quality_filter(spark, docs, small).count() == 2
