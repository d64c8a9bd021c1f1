"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

import re

import pytest

import corpus_pipeline
import oracle
from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 14)]


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_oracle(spark, name):
    diff, _ = oracle.differences(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLE[name], SF)
    assert diff == ""


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = left
        path = corpus_pipeline.fresh_folder(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            break
        assert docs.columns == columns
        left = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_classifier":
            assert set(left) <= set(before) and len(left) >= 0.75 * len(before)
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i] or ""), i)
            assert set(left) == set(first.values())
        elif name == "jaccard_join":
            from test_dedup import plain_near

            assert set(left) == {i for i, (_, low) in plain_near(before.items(), 5, 80).items() if i == low}
        else:
            hidden = {i: re.sub(r'(token = ")[0-9a-f]{40}', r"\1[SECRET]", t) for i, t in before.items()}
            assert left == hidden
    assert {r.doc_id for r in docs.collect()} == set(left)
