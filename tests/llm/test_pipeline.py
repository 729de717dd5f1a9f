from conftest_llm import plain_shingles

import corpus_pipeline
from tidegate.llm import decontamination, secrets


def test_stages(spark, sf_dir, documents, tmp_path):
    docs, seen = documents, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    good, distinct, clean, masked, packed = seen.values()
    # near duplicates: by brute force no two kept ones are similar, and everything dropped has a kept group
    rows = [(r.doc_id, plain_shingles(r.text, 5)) for r in good.collect()]
    kept = {r.doc_id for r in distinct.collect()}
    sets = dict(rows)
    alike = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    assert not [(i, j) for i in kept for j in kept if i < j and alike(sets[i], sets[j])]
    assert all(any(alike(s, t) for j, t in rows if j < i) for i, s in rows if i not in kept)
    # decontamination: what goes holds a passage
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = {r.doc_id for r in decontamination.find_passages(distinct, items).collect()}
    assert {r.doc_id for r in clean.collect()} == kept - dirty
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: secrets.mask(r.text) for r in clean.collect()}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in masked.collect()}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
