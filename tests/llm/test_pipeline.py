"""The pipeline against brute force over its stages."""

import random

import corpus_pipeline
from loupe.llm import decontam, pii, quality, token_shards
from test_operators import DOCS, brute_pairs, packed_texts, words


def world(spark, folder):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(300)]
    item = " ".join(f"item{i}" for i in range(20))
    texts = []
    for i in range(120):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 60)))
        texts.append("### ".join(text.upper().split()) if i % 4 == 0 else text + ".")
    texts[9] += " " + item
    texts[10] += " mail someone@example.org now"
    texts.append(texts[13] + " more")
    texts.append(texts[14])
    texts += ["", "tiny"]
    rows = [*enumerate(texts), (500, None), (None, texts[17] + " extra")]
    full = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", "y") for i, t in rows]
    spark.createDataFrame(full, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = world(spark, str(tmp_path))
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r.doc_id, r.text) for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/stage{k}")
        docs = spark.read.parquet(f"{sf_dir}/stage{k}")
        if name == "packing":
            break
        assert docs.columns == names
        after = {(r.doc_id, r.text) for r in docs.collect()}
        if name == "quality":
            import pyarrow as pa

            ids = sorted(before, key=str)
            score = model.calibrated(model.raw(quality.statistics(pa.array([t for _, t in ids], pa.large_string()))))
            assert after == {x for x, s in zip(ids, score) if s >= quality.THRESHOLD}
            assert all((i, t) in after for i, t in rows if i is not None and i < 120 and i % 4)
        elif name == "near duplicates":
            gone = {b for _, b in brute_pairs(before, 0.6)}
            assert after == {(i, t) for i, t in before if i not in gone and not (i is None and t)}
            assert {120, 121} & {i for i, _ in before} <= gone
        elif name == "decontaminate":
            item = words(" ".join(f"item{i}" for i in range(20)))
            bad = {i for i, t in before if decontam.best_match(item, words(t))[0] <= decontam.budget(20)}
            assert bad == {9} and after == {x for x in before if x[0] not in bad}
        elif name == "pii":
            assert after == {(i, pii.redacted(t)) for i, t in before}
            assert any(t and "<EMAIL>" in t for _, t in after)
    packed = docs.collect()
    left = {r.doc_id for r in packed}
    assert left == {i for i, _ in before} and all(r.start + r.length <= 2048 for r in packed)
    # the bins give back every text that the stages kept, as they left it
    assert sorted(packed_texts(packed, token_shards.Encoder()), key=str) == sorted(((i, t or "") for i, t in before), key=str)


def test_run_is_the_stages_in_order(spark, tmp_path):
    world(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "decontaminate", "pii", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "length", "bin", "start", "ids"] and got.count() > 50
    # the same as the stages one by one
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/one{k}")
        docs = spark.read.parquet(f"{tmp_path}/one{k}")
    assert sorted(map(str, got.select("doc_id", "piece", "length", "ids").collect())) == sorted(
        map(str, docs.select("doc_id", "piece", "length", "ids").collect())
    )


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", DOCS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.collect() == [] and "ids" in got.columns
