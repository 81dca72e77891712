"""The pipeline's stages on a small corpus."""

import corpus_pipeline
from stratafold.llm import decontamination, near_dedup, quality_rules, secrets


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        if name == "quality rules":
            field = quality_rules.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert out.count() == quality_rules.judge(docs, field).where("kept").count()
        elif name == "near duplicates":
            assert out.count() == near_dedup.classes(docs).where("representative").count()
        elif name == "decontamination":
            found = decontamination.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert out.count() == docs.count() - found.select("doc_id").distinct().count()
        elif name == "secrets":
            assert out.count() == docs.count() and secrets.scan(out).where("n_assign + n_access + n_hex > 0").isEmpty()
        else:
            assert out.count() == docs.count() and out.where("not round_trip").isEmpty()
        docs = out
    assert 0 < docs.count() < before


def test_empty_corpus(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_run_on_a_made_corpus(spark, sf, tmp_path):
    """What goes, what stays and what is masked is known beforehand; only the last stage's folder is left."""
    import random
    import shutil

    words = [a + b for a in ("re", "an", "the", "ou", "sti") for b in ("on", "er", "ing", "ble", "s", "tion")]

    def text(seed, n=60):
        rng = random.Random(seed)
        return "\n".join(" ".join(rng.choice(words) for _ in range(n // 3)).capitalize() + "." for _ in range(3))

    item = text(900, 30).replace("\n", " ")
    near = text(3).split(" ")
    near[20] = "changed"
    rows = [
        (1, text(1)), (2, text(2)), (2, text(2)), (3, text(3)), (4, " ".join(near)), (5, text(1).upper().lower().capitalize()), (6, f"{text(6)}\n{item.upper()}\n{text(7)}"), (7, f"{text(8)}\nmy token = abcdef0123 ok."),
        (8, "few words"), (9, None), (None, text(10)), (10, ""), (11, "buy buy buy buy buy buy " * 20), (12, text(12, 3000)), (13, "win### " * 5 + " | ".join("abcdefghijklmnopqrstu")),
    ]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rid long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (13, 0, 0), (11, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 7, 12] and out.where("not round_trip").isEmpty()
    from stratafold.llm import piece_codec

    texts = {r.doc_id: r.text for r in piece_codec.decode(out).collect()}
    assert texts[12] == text(12, 3000) and texts[7] == f"{text(8)}\nmy [SECRET] ok."
    folder = out.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    import os

    assert os.listdir(folder) == [str(len(corpus_pipeline.STAGES) - 1)]
    shutil.rmtree(folder)
