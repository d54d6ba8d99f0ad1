import random

import corpus_pipeline
from cases import nasty_rows, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, path, docs):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(11)
    clean = {i: prose(rng, 150) for i in range(300)}
    docs = dict(clean)
    labels = []
    for i in range(300, 380):  # toxic, and their labels
        docs[i] = prose(rng, 60) + " zorgle " + prose(rng, 60) + " zorgle"
        labels.append((i, 1, 1))
    labels += [(i, 1, 0) for i in range(200)]
    exact = {400 + i: clean[i].upper() for i in range(5)}
    near = {}
    for i in range(10, 15):
        words = clean[i].split()
        words[-1] = "ending"
        near[500 + i] = " ".join(words)
    items = [(i, prose(rng, 30)) for i in range(5)]
    leaks = {600 + i: prose(rng, 100) + " " + t + " " + prose(rng, 100) for i, t in items}
    docs |= exact | near | leaks | {700: "", 701: None}
    written(spark, tmp_path, docs.items())
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stays = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stays = stage(spark, stays, str(tmp_path))
        assert stays.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in stays.collect()})
    assert left[0] == set(docs) - set(range(300, 380))
    assert left[1] == left[0] - set(range(5)) - {700}
    assert left[1] - left[2] == set(near)
    assert left[3] == left[2] - set(leaks)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == left[3]


def test_nasty_and_empty_tables(spark, tmp_path):
    for name, docs in (("nasty", [(i, t) for i, t, *_ in nasty_rows()]), ("empty", [])):
        path = f"{tmp_path}/{name}"
        written(spark, path, docs)
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert bool(out) == bool(docs)
