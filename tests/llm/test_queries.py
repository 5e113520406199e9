"""The registered queries against their SQL, and the pipeline against its operators."""

import corpus_pipeline
import oracle
import pytest

import __spark_entry__ as entry
from sparkloom.llm import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert oracle.compare(spark, QUERIES[name], ORACLE[name], SMALL) == 200


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns and docs.count() > 0, name
    want = corpus_pipeline.encoding_stage(spark, docs, SMALL)
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
