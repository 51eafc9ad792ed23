"""The pipeline against its stages' plain results."""

import corpus_pipeline
from rampart.llm import mixing, rule_ensemble
from rampart.llm.common import table, written
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = table(spark, SF, "documents")
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, at, SF))
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        rows = [(r.doc_id, r.text) for r in at.select("doc_id", "text").collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if k == 0:
            want = [r.doc_id for r in rule_ensemble.quality_scores(at, labels).where("predicted = 1").collect()]
        elif k == 1:
            want = {c for _, _, c in plain.ngram_components(rows)}
        elif k == 2:
            items = [(r.item_id, r.text) for r in bench.collect()]
            want = [r[0] for r in plain.contamination(rows, items) if not r[-1]]
        elif k == 3:
            rates = mixing.mixing_rates(at, mixing.labelled_domains(at, labels))
            want = [r.doc_id for r in rates.collect() for _ in range(r.copies)]
        else:
            want = [i for i, _ in rows]
            assert out.columns == [*docs.columns, "slot", "shard"]
        assert ids == sorted(want), name
        at = out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == ids


def test_odd_documents_go_through_every_stage(spark, tmp_path):
    from tests.oracle import TABLES

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    docs = table(spark, SF, "documents")
    good = docs.where("lang = 'en'").orderBy("doc_id").first()
    odd = [(None, good.text, "en", None, None), (10**6, None, None, None, None), (10**6, "", None, None, None), (10**6 + 1, good.text, "en", None, None), (10**6 + 1, good.text, "en", None, None), (10**6 + 2, "word " * 200_000, "en", None, None)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"stats": docs.doc_id, "rate": docs.lang, "slot": docs.lang, "label": docs.doc_id})
    at = written(both)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, at, str(tmp_path)))
        if k < 4:
            assert out.columns == both.columns
            assert out.join(at.select("doc_id", "text"), out.doc_id.eqNullSafe(at.doc_id) & out.text.eqNullSafe(at.text), "left_anti").count() == 0
            assert stage(spark, at.limit(0), str(tmp_path)).collect() == []
        at = out
    assert at.columns == [*both.columns, "_slot", "shard"]
