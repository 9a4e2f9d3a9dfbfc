import pytest
from pyspark.sql import functions as F

from runlens import hooks
from runlens.catalog import reports, trust
from runlens.operators import surface
from runlens.plans import report
from runlens.sources import tables

DIR = "/root/testdata/sf0.001"


def parts(spark):
    return tables.scores(spark, DIR), trust._validated(spark, DIR), trust._records(spark, DIR)


def test_stale_records_stop_the_report(spark):
    scores, validations, records = parts(spark)
    with pytest.raises(report.Refused, match="older than their inputs"):
        report.report(scores, validations, records, report.Ask())
    fresh = records.withColumn("record", F.lit(10_000))
    assert report.report(scores, validations, fresh, report.Ask())["stale"].count() == 0


def test_each_stage_says_what_it_set_aside(spark, tmp_path):
    scores, validations, records = parts(spark)
    ask = report.Ask(variant="1-URGENT", impl="py", allow_stale=True)
    experiment = hooks.Experiment()
    experiment.register_summary("groups", lambda cells, metrics: metrics(cells))
    made = report.write(report.report(scores, validations, records, ask, experiment), str(tmp_path))
    tainted = validations.where("verdict = 'TAINTED'").count()
    assert made["excluded"].count() == tainted and made["stale"].count() > 0
    kept = scores.count() - tainted
    assert [(r.cut, r.of) for r in made["cuts"].orderBy("step").collect()][0] == ("variant", kept)
    assert made["rows"].count() == made["cuts"].where("cut = 'impl'").first().kept == spark.read.option("header", "true").csv(f"{tmp_path}/rows.csv").count()
    assert made["groups"].count() == made["board"].count()
    whole = report.report(scores, validations, records, report.Ask(allow_stale=True, include_tainted=True))
    assert whole["excluded"].count() == 0 and whole["rows"].count() == scores.count() and "cuts" not in whole
    experiment.register_summary("rows", lambda cells, metrics: metrics(cells))
    with pytest.raises(ValueError, match="rows"):
        report.report(scores, validations, records, ask, experiment)


def test_the_board_is_numbered_in_the_order_asked_for(spark):
    made = reports._report(spark, DIR)["board"].orderBy("pos").collect()
    assert [r.pos for r in made] == list(range(1, len(made) + 1))
    lacks = [r.base_n is None for r in made]
    assert lacks == sorted(lacks)


def test_tree_digests_of_many_files(spark):
    import hashlib
    files = [(t, f"d{i % 7}/f{i}", f"content {i}") for t, n in (("a", 500), ("b", 1), ("c", 33)) for i in range(n)]
    df = spark.createDataFrame(files, "tree string, rel string, content string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {r.tree: (r.files, r.fingerprint) for r in surface.fingerprint(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = lambda t: "".join(f"{sha(c)}  {r}\n" for r, c in sorted((r, c) for x, r, c in files if x == t))
    assert got == {t: (n, sha(text(t))) for t, n in (("a", 500), ("b", 1), ("c", 33))}
