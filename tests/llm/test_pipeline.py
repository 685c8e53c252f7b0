"""The pipeline's stages on planted cases, each against its brute-force decision."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from lociq.llm import toxicity
from lociq.llm._common import Scratch, connected_components


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n)]


def planted(spark, path):
    rows = [(i, " ".join(words(60, i)) + "\n" + " ".join(words(30, 5000 + i)), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, " ".join(words(40, 900 + i)) + " idiot moron scum", "en", "s9") for i in range(30)]
    near = rows[3][1].split(" ")
    near[20] = "edit"
    item = words(30, 4242)
    rows += [(300, " ".join(near), "en", "s1"), (301, rows[5][1], "en", "s2"), (302, " ".join(words(10, 1) + item + words(12, 2)), "en", "s1"), (303, None, "en", "s1"), (304, "", "en", None)]
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, p_toxic string, row string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in rows if r[0] < 100 or 200 <= r[0] < 220], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {r[0]: r for r in rows}


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    d = str(tmp_path)
    planted(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left, scratch = {}, Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = scratch.save(stage(spark, docs, d))
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "pack" or docs.columns == before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]
    clean = set(range(120))
    assert left["toxicity"] == clean | {300, 301, 302, 303, 304}
    assert left["line_dedup"] == left["toxicity"] - {301}
    assert left["near_dedup"] == left["line_dedup"] - {300}
    assert left["decontaminate"] == left["near_dedup"] - {302}
    assert left["pack"] == clean
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_texts_go_to_the_classifier_in_small_batches(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    rows = planted(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").crossJoin(spark.range(20).select()).coalesce(1)
    most, plain = corpus_pipeline.TEXTS, toxicity.predict_chain

    def checked(models, sets):
        assert len(sets) <= most, len(sets)
        return plain(models, sets)

    monkeypatch.setattr(toxicity, "predict_chain", checked)
    left = corpus_pipeline.drop_toxic(spark, docs, d)
    assert left.columns == docs.columns and left.count() == 20 * 125 > most
    assert {tuple(r) for r in left.collect()} == {(*r, None if r[1] is None else len(r[1]), "x", "y") for k, r in rows.items() if not 200 <= k < 300}


def test_stages_take_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    planted(spark, d)
    none = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_formatting_keeps_no_python_in_native_plans(spark, tmp_path):
    from lociq.llm import chat, secrets

    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(1, "token=abcdefgh12", "s")], "doc_id long, text string, source string")
    for df in (chat.chat_digests(rows), secrets.scan(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), F.lit(plan)
