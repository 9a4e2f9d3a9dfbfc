import random

import corpus_pipeline
from runlens.llm.shared import written


def corpus(spark, n=120):
    rnd = random.Random(12)
    words = [a + b for a in ("riv", "Sto", "été", "üb", "pa", "li", "mo", "tre") for b in ("er", "ne", "th", "ght", "on", "e.", "el", "as", "im", "ut")]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(60, 300)) + [f"w{j * i}" for j in range(20)]), "en", rnd.choice("aab"), 0, "x") for i in range(n)]
    rows += [(n + i, rows[i][1].replace(" ", "\n", 3), "en", "a", 0, "x") for i in range(5)]  # equal after white space
    rows += [(n + 10, "spam " * 200, "en", "a", 0, "x"), (n + 11, None, None, None, None, None), (n + 12, "", "en", "b", 0, "x"), rows[3]]
    labels = [(i, 1, 0) for i in range(n)] + [(n + 10, 0, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_stages_one_by_one(spark, tmp_path):
    docs, labels = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, now, str(tmp_path)))
        if name != "best_fit_packing":
            assert new.columns == docs.columns
        ids[name] = [r[0] for r in new.select("doc_id").collect()]
        now = new
    assert set(ids["quality_rules"]) == set(range(125))
    assert sorted(ids["exact_dedup"]) == list(range(120))
    assert len(ids["near_dedup"]) == len(set(ids["near_dedup"])) and set(ids["near_dedup"]) <= set(range(120))
    assert set(ids["mix_sources"]) == set(ids["near_dedup"]) and len(ids["mix_sources"]) > len(ids["near_dedup"])
    assert set(ids["best_fit_packing"]) == set(ids["mix_sources"])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == now.count()


def test_empty_tables_and_no_labels(spark, tmp_path):
    docs, labels = corpus(spark, 20)
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs.limit(0), docs):
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, str(tmp_path)))
        assert (now.count() > 0) == (rows is docs)
