import random

import corpus_pipeline
import pytest
from runlens.llm import components, mixing, near, packing, queries, simhash
from runlens.llm.shared import written


def nodes(plan):
    yield plan
    for i in range(plan.children().length()):
        yield from nodes(plan.children().apply(i))


def guessed(df):
    """Broadcasts whose rows come from files without a shuffle between, so that their size is not measured first."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    found = [list(nodes(x)) for x in nodes(plan) if x.nodeName() == "BroadcastExchange"]
    return [x[0].treeString() for x in found if not any(y.nodeName() == "Exchange" for y in x[1:])]


@pytest.fixture
def planned(monkeypatch):
    """The plans of all tables that the stages write."""
    seen = []

    def noted(df):
        seen.extend(guessed(df))
        return written(df)

    for module in (components, simhash, near, mixing, packing, corpus_pipeline):
        monkeypatch.setattr(module, "written", noted)
    return seen


def corpus(spark, path):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(80)) for _ in range(40)]
    texts += [t + " end" for t in texts[:20]] + [" ".join([*t.split()[:77], *[f"own{k}x{i}" for i in range(3)]]) for k in range(4) for t in texts[:5]]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_links_of_many_keys_a_print_are_not_broadcast(spark):
    prints = written(spark.range(50).selectExpr("xxhash64(id) AS fp"))
    assert "BroadcastExchange" not in simhash.links(prints)._jdf.queryExecution().executedPlan().toString()


def test_op10_broadcasts_no_rows_of_guessed_size(spark, planned, tmp_path):
    docs = corpus(spark, tmp_path)
    found = queries.op10_simhash(spark, str(tmp_path))
    assert planned + guessed(found) == []
    assert found.count() == docs.count()


def test_pipeline_broadcasts_no_rows_of_guessed_size(spark, planned, tmp_path):
    now = corpus(spark, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert planned + guessed(out) == []
        now = written(out)
    assert now.count() > 0
