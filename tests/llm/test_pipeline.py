"""The pipeline's stages against brute force and against each other."""

from tests.llm import brute
from tests.llm.test_operators import edited, prose

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base, item = prose(90, 11), prose(30, 12)
    texts = {0: base, 1: base, 2: edited(base, 2, 13), 3: prose(100, 14), 4: "too short", 5: prose(60, 15) + " " + item, 6: prose(80, 16) + " me.you@mail.example.com", 7: None, 8: prose(70, 17)}
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, COLS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "personal data", "mixing"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
        seen.append(docs)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(s.columns == columns for s in seen[:-1])
    ids = [sorted({r.doc_id for r in s.select("doc_id").collect()}) for s in seen]
    good = [i for i, t in texts.items() if len((t or "").split()) >= 50]
    assert ids[0] == good
    comp = brute.components([(i, texts[i]) for i in good])
    assert ids[1] == [i for i in good if comp[i][1] == i]
    assert ids[2] == [i for i in ids[1] if i != 5]
    assert ids[3] == ids[2]
    changed = {r.doc_id: r.text for r in seen[3].collect()}
    assert all((changed[i] == texts[i]) == (i != 6) for i in ids[3]) and "me.you@mail" not in changed[6]
    assert {"mix_shard", "mix_order"} <= set(seen[4].columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
