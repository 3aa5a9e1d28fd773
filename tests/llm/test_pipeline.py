import corpus_pipeline
from tablecare.llm import common
from tablecare.llm.common import written

from .helpers import EDGES, SMALL, documents


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SMALL), "stage")
        assert out.columns == columns, name
        assert 0 < out.count() and (name == "mixing" or out.count() <= n)
        docs, n = out, out.count()
    assert docs.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9]+[.][a-z]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.count() >= docs.count()
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.columns == packed.columns and whole.count() == packed.count()


def test_stages_on_edges_and_nothing(spark, tmp_path):
    docs = documents(spark, EDGES, tmp_path)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SMALL).count() >= 0


def test_stages_leave_only_what_their_result_reads(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 91}" for j in range(1, 40)) for i in range(1, 30)]
    rows = [(i, texts[i // 2 % len(texts)] + " tail" * (i % 2), "ab"[i % 2]) for i in range(80)]
    docs = documents(spark, rows, tmp_path)
    left = {"quality rules": {"quality-cutoffs"}, "near duplicates": {"jaccard-rows", "jaccard-gone"}, "personal data": set(),
            "mixing": {"mix-rows", "mix-plan", "mix-other"}, "packing": {"pack-pieces"}}
    for name, stage in corpus_pipeline.STAGES:
        folder = tmp_path / name.replace(" ", "-")
        folder.mkdir()
        monkeypatch.setattr(common, "ensure_checkpoint_dir", lambda _, folder=folder: str(folder))
        assert stage(spark, docs, SMALL).count() > 0
        assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir()} == left[name], name
