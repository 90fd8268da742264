"""The pipeline's stages, one after the other, against what each must keep."""

import corpus_pipeline as cp
from tablesieve.llm import jaccard

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for number, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if number == len(cp.STAGES) - 1:
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items() and after
        if name == "quality_rules":
            assert all(len(t.split()) >= 50 for t in after.values())
            gone = [k for k in before.keys() - after.keys() if len(before[k].split()) >= 50]
            assert sum(labels.get(k) == 1 for k in gone) <= 0.03 * len(after)
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        if name == "near_duplicates":
            classes = jaccard.near_duplicates(spark.read.parquet(str(tmp_path / "language_id"))).collect()
            assert set(after) == {r.component_id for r in classes}
        before = after
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(before)
    whole = sorted(map(tuple, cp.run(spark, SF).collect()))
    assert whole == sorted(map(tuple, packed))
