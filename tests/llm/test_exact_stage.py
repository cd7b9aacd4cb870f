import corpus_pipeline


def test_exact_stage_keeps_one_row_of_a_doc_id(spark, sf_dir):
    """Equal after lower-casing, or null and empty, under one doc_id: one row each."""
    df = spark.createDataFrame([(7, "Ab c"), (7, "aB c"), (7, "ab C"), (8, None), (8, ""), (6, "ab c"), (9, "z")], "doc_id long, text string")
    got = corpus_pipeline.exact(spark, df, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == [7, 8, 9]
