"""The stages on tables with nulls, empty and long texts, repeated rows, extra columns, and none at all."""

import pytest

import corpus_pipeline

LONG = " ".join(f"word{k % 997}" for k in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row long"
TEXTS = [None, "", " \n\t ", "a", "one line of many words here and there\n" * 3, LONG, LONG, "é ü ß \x00", "x" * 6000]
ROWS = [(k, t, None if k % 3 else "en", None if k % 2 else "s", None, "clash", 7) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[4], ROWS[4], (None, "text of no id at all", None, None, 5, None, None), (None, None, None, None, None, None, None)]


LABELS = [(3, 1), (5, 0), (7, 1), (None, 1), (4, None)]


@pytest.mark.parametrize(("rows", "labels"), [(ROWS, LABELS), (ROWS, []), ([], LABELS)], ids=["odd", "odd_without_labels", "empty"])
def test_stages_take_odd_tables(spark, tmp_path, rows, labels):
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert sorted(got.columns) == sorted(docs.columns)
        got.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        if k == 2 and rows and not labels:  # nothing rejected: each text with words once
            texts = [r.text for r in docs.collect()]
            assert texts.count(LONG) == 1 and sum("many words" in (t or "") for t in texts) == 1 and "text of no id at all" in texts
    assert (docs.count() == 0) == (not rows or docs.isEmpty())
