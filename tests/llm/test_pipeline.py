import random

import corpus_pipeline
from tests.llm.test_others import labelled


def test_stages(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, t) for i, t, _ in labelled(300)]
    clean = [(i, t) for i, t, y in labelled(300) if not y]
    near = [(1000 + i, t + " extra") for i, t in clean if len(t.split()) > 40][:20]
    passage = " ".join(f"shared{rnd.randrange(50)}" for _ in range(60))
    shared = [(2000 + i, " ".join(f"open{i}x{k}" for k in range(60)) + f" {passage} closing {i}") for i in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows + near + shared], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in labelled(300)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == names
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i, _ in clean}) >= 0.98 * len(clean) and len(ids - {i for i, _ in clean + near + shared}) <= 3
    one = corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    left = {r.doc_id for r in one.collect()}
    assert one.columns == names and not left & {i for i, _ in near} and left >= ids & {i for i, _ in clean}
    cut = corpus_pipeline.drop_repeated_passages(spark, one, str(tmp_path))
    assert cut.columns == names and cut.count() == one.count()
    text = {r.doc_id: r.text for r in cut.collect()}
    assert passage in text[2000] and passage not in text[2001]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left
