import shutil

import corpus_pipeline as pipeline
from lapidary.llm.scratch import Scratch
from tests.llm.helpers import docs_frame


def test_stages_on_small_rows(spark, tmp_path):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, base), (2, base + " "), (3, base.upper()), (4, "mail a.b@c.example now", "t"), (5, None), (6, ""), (6, ""), (None, "no id"), (7, "other " * 50)]
    frame = docs_frame(spark, rows)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, scratch = frame, Scratch(spark)
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == frame.columns
        kept[name] = docs.collect()
    assert len(kept["toxicity"]) == len(rows)
    assert sorted(r.doc_id for r in kept["near_dedup"] if r.doc_id is not None) == [1, 4, 5, 6, 7] and sum(r.doc_id is None for r in kept["near_dedup"]) == 1
    assert not any("a.b@c" in (r.text or "") for r in kept["pii"])
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in out) > 0
    shutil.rmtree(tmp_path, ignore_errors=True)
