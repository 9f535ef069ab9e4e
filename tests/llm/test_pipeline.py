import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept[1] > 0.8 * kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2]
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(pieces.columns) and pieces.count() >= kept[4]
