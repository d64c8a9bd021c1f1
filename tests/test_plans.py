"""What the plans must hold at scale."""

import re

import pytest

from corpusloom.operators import sampling
from corpusloom.plans import registry, views

SF = "/root/testdata/sf0.001"
SLOW_PATHS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_no_cross_join_and_no_python_workers(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert not [p for p in SLOW_PATHS if p in text]


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<text:string>" in plan(registry.QUERIES["src_parquet_pruned"](spark, SF))
    text = plan(registry.QUERIES["run_grid"](spark, SF))
    assert "ReadSchema: struct<source:string>" in text


def test_filters_reach_the_scan(spark):
    text = plan(registry.QUERIES["warning_filter"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in text
    assert "EqualTo(quality,1)" in plan(views.labeled(spark, SF))
    assert "EqualTo(role,system)" in plan(views.turns(spark, SF).where("`from` = 'system'"))


def test_cap_filters_texts_without_a_shuffle(spark):
    """The cut is broadcast; only narrow keys are shuffled to find it, and no text."""
    text = plan(registry.QUERIES["per_source_cap"](spark, "/root/testdata/sf0.01").drop("x"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_queue_sorts_without_texts(spark):
    """The range sort of the pending queue has lengths and keys only."""
    text = plan(registry.QUERIES["pending_queue"](spark, SF))
    sort = text[text.index("Sort [chars"):]
    between = sort[: sort.index("Project")]
    assert "rangepartitioning(chars" in between and "conversation" not in between
    assert "AS chars" in sort[sort.index("Project"):].splitlines()[0]


def test_mixture_hashes_all_texts_once(spark, monkeypatch):
    """Both draws and their targets take their n-grams from one pass over the documents."""
    made, real = [], sampling.gram_buckets

    def counted(docs, text, *rest):
        if not dict(docs.dtypes)[text].startswith("array"):
            made.append(text)
        return real(docs, text, *rest)

    monkeypatch.setattr(sampling, "gram_buckets", counted)
    registry.QUERIES["mixture_build"](spark, SF)
    assert made == ["text"]


def test_passages_take_three_words_from_the_head(spark, tmp_path):
    """Not all words of a text are cut to have its first three; odd texts give the same as a cut of the whole."""
    texts = [None, "", " \t ", "one", " two  words\n", "a b c", "\ta\x0bb\u3000c\rd e f ", "x" * 50_000, "w " * 20_000, "日本 \x85 é\u0301 z"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "q")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = views.passages(spark, str(tmp_path))
    got = {r["doc_id"]: r["spans"] for r in df.collect()}
    assert got == {i: t if t is None else re.findall(r"[^ \t\n\r\f]+", t)[:3] for i, t in enumerate(texts)}
    assert "{0,3}" in df._jdf.queryExecution().optimizedPlan().toString()


def test_labelled_documents_are_not_shuffled(spark):
    """Beyond Spark's own threshold too, the counted ids go to the documents and not the texts to the ids."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(views.labeled(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
