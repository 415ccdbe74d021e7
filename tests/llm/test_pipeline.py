import pytest
from rosterlane.llm.mixing import WEIGHTS, mix
from rosterlane.llm.toxicity import fit, grade
from tests.llm import cases
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dup import brute as components
from tests.llm.test_token_files import expected

pipeline = pytest.importorskip("corpus_pipeline")


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf_dir}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in grade(docs, fit(docs, labels)).where("rejected").collect()}
    text = dict(cases.corpus(spark, sf_dir))
    left = {i: t for i, t in text.items() if i not in toxic}
    kept = {i for i, _, _, keep in components(left.items()) if keep}
    final = [i for i in sorted(kept) if not contaminated(text[i], items)[4]]
    slots = {r.doc_id: (r.slot, r.place, r.doc_id) for r in mix(docs.where(docs.doc_id.isin(final)), WEIGHTS).collect()}
    rows = expected([(i, text[i]) for i in sorted(final, key=slots.get)])
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).collect())) == sorted(rows)
    assert toxic and len(kept) < len(left) and len(final) < len(kept)


def test_stages_keep_rows_as_they_are(spark, sf_dir):
    docs = cases.frame(spark, ["slot", "kept", "n_words", "contaminated", "__k"])
    given = sorted(map(repr, docs.collect()))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = sorted(map(repr, out.collect()))
        if name == "near_duplicates":
            assert set(rows) < set(given) and {r.doc_id for r in out.collect()} >= {0, 1, 2, 3, None}, name
        else:
            assert rows == given, name
        assert stage(spark, cases.empty(spark), sf_dir).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(cases.rows())
    assert pipeline.STAGES[-1][1](spark, cases.empty(spark), sf_dir).count() == 0


def test_run_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
