import corpus_pipeline
from sitefold.llm import language_id
from tests.llm.cases import frame, prose


def test_stages_take_effect(spark, tmp_path):
    near = prose(2, 300).split()
    near[150] = "changed"
    item = prose(70, 25)
    rows = [(i, prose(i, 40 + i)) for i in range(10, 40)]
    rows += [(1, None), (2, "123 456"), (3, rows[0][1].replace(" ", "\n ")), (50, prose(2, 300)), (51, " ".join(near)), (52, prose(8, 30) + " " + item), (10, rows[0][1])]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = sorted(r["doc_id"] for r in now.select("doc_id").collect())
    clean = list(range(11, 40))
    assert kept["language ID"] == sorted([3, 10, 10, 50, 51, 52, *clean])
    assert kept["exact dedup"] == sorted([3, 50, 51, 52, *clean])
    assert kept["n-gram Jaccard join"] == sorted([3, 50, 52, *clean])
    assert kept["benchmark decontamination"] == sorted([3, 50, *clean])
    assert sorted(set(kept["packing"])) == kept["benchmark decontamination"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, now.collect()))


def test_empty_documents(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_is_the_operator(spark):
    docs = frame(spark)
    assert sorted(map(str, corpus_pipeline.language_stage(spark, docs, "").collect())) == sorted(map(str, language_id.recognised(docs).collect()))
