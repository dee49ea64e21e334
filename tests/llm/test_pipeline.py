"""The pipeline: each stage on its own input, and the whole against the stages one by one."""

import corpus_pipeline as pipeline

from contactloom.session import written

from . import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    given, states = docs, []
    for name, stage in pipeline.STAGES:
        given = written(stage(spark, given, sf_dir), "test-stage")
        states.append(given)
        if name != "sentencepiece":
            assert given.columns == columns
    assert states[0].count() >= 0.97 * docs.count()
    lined = [(r.doc_id, r.text) for r in states[1].collect()]
    smallest = {c for _, _, c in brute.jaccard_components(lined)}
    assert {r.doc_id for r in states[2].collect()} == smallest
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r.doc_id for r in states[3].collect()}
    texts = {r.doc_id: r.text for r in states[2].collect()}
    for i in [i for i in texts if i not in clean] + sorted(clean)[:10]:
        assert brute.decontaminated(texts[i], items)[4] == (i not in clean)
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, states[4].collect()))


def test_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kind int, line string, rejected string"
    rows = [(1, None, None, None, None, "a", 1, "b", "c"), (2, "", "en", "s", 0, None, None, None, None)]
    rows += [(3, "the text of a document " * 9, "en", "s", 5, "x", 2, "y", "z")] * 2
    for table in (rows, []):
        given = spark.createDataFrame(table, schema)
        for name, stage in pipeline.STAGES:
            done = stage(spark, given, sf_dir)
            assert done.count() <= len(table)
            if name != "sentencepiece":
                assert done.columns == given.columns
