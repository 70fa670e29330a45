import hashlib

import corpus_pipeline
from lodestone.llm import language_id, quality


def test_stages_keep_what_they_should(spark, sf):
    """Each stage on what the one before kept; its decisions against the operators' own results and brute force."""
    from test_llm_operators import brute_groups, brute_hits

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language"](spark, docs, sf).cache()
    assert kept.columns == docs.columns
    rejected = language_id.identify(docs, language_id.train(docs)).where("rejected").count()
    assert kept.count() == docs.count() - rejected
    good = steps["quality"](spark, kept, sf).cache()
    model, _ = quality.fit(kept, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = kept.select("doc_id", "text").collect()
    import pyarrow as pa

    score = model.score(quality.statistics(pa.array([t.text.encode() for t in texts], pa.large_binary())))
    assert {r.doc_id for r in good.collect()} == {t.doc_id for t, s in zip(texts, score, strict=True) if s >= 0.7}
    single = steps["near_duplicates"](spark, good, sf).cache()
    groups, n = brute_groups([tuple(r) for r in good.select("doc_id", "text").collect()])
    assert {r.doc_id for r in single.collect()} == {g for _, g, _ in groups} and single.count() == n
    clean = steps["benchmark"](spark, single, sf).cache()
    hits = brute_hits([tuple(r) for r in single.select("doc_id", "text").collect()], [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert {r.doc_id for r in clean.collect()} == set(hits[~hits.contaminated].doc_id)
    tokens = steps["tokens"](spark, clean, sf).join(clean.select("doc_id", "text"), "doc_id").collect()
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in tokens) and len(tokens) == clean.count()


def test_run_equals_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else docs


def test_odd_documents(spark, sf):
    """Null ids and texts, repeated rows, very long texts and columns named as results, with a table's own documents to learn from."""
    from pyspark.sql import functions as F

    own = spark.read.parquet(f"{sf}/documents.parquet")
    some = own.where("lang IS NOT NULL AND n_chars > 200").orderBy("doc_id").first()
    odd = [(None, some.text, None, "x", 1), (90_001, None, None, None, 0), (90_002, "", "en", "x", 0), (90_003, "12 34 !!", None, "x", 8), (90_004, some.text * 40, None, "x", None), (90_005, "short", None, "x", 5), (90_005, "short", None, "x", 5)]
    docs = own.unionByName(spark.createDataFrame(odd, own.schema)).withColumns({"Score": F.lit("mine"), "rejected": F.lit(1), "n_hit": F.lit(2), "KEY": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        if name != "tokens":
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0 and docs.where("Score <> 'mine' OR rejected <> 1").count() == 0
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and not {90_001, 90_002, 90_003} & set(ids)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(own.limit(5), none).where("predicted = 1").count() == 0
