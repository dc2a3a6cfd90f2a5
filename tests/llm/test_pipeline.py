"""The pipeline's stages one after another, on a small corpus with planted cases."""

import random

import corpus_pipeline
from lossgrid.llm import common, quality_rules


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = quality_rules.FREQUENT["en"] * 3 + [f"{a}{b}" for a in ("lo", "ri", "an", "te") for b in ("ver", "nd", "mo", "sk", "pla")]
    text = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(10)).capitalize() + "." for _ in range(n))
    good = [text(20) for _ in range(60)]
    bad = ["\n".join(" ".join("Zz%%%" + str(rng.randrange(99)) + "&&&" for _ in range(8)) for _ in range(12)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*good, *bad, good[0], good[1].replace(".", ". ", 1)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, str(tmp_path)), "test-stage")
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert name == "packing" or docs.columns == columns
    assert set(kept[0]) == {*range(60), 120, 121} and set(kept[1]) == set(kept[0])
    assert sorted(kept[2]) == list(range(60))
    assert set(kept[3]) <= set(kept[2]) and set(kept[4]) == set(kept[3])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near-dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
