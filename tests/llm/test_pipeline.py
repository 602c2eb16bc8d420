import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlab.llm import op1_decontamination, op5_packing, op8_toxicity

from .common_cases import docs, odd, saved
from .test_jaccard import brute as brute_groups
from .test_line_dedup import brute as brute_lines

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/{k}")
        out.append((before, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_on_its_own_input(spark, stages):
    for before, after in stages[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS and after.dtypes == before.dtypes
    (docs, clean), (_, lines), (_, single), (_, fair), (_, packed) = stages
    lexicon = op8_toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet").where(~op8_toxicity.held_out()))
    assert set(texts(clean)) == {r.doc_id for r in op8_toxicity.score_toxicity(docs, lexicon).where("score < 0.5").collect()}

    held = texts(clean)
    order = sorted(held)
    expected = brute_lines([held[i] for i in order], 10)
    assert texts(lines) == {i: expected[k][0] for k, i in enumerate(order)}

    held = texts(lines)
    order = sorted(held)
    groups = brute_groups([held[i] for i in order], 5, 80)
    assert texts(single) == {i: held[i] for k, i in enumerate(order) if groups[k][1] == k}

    marked = op1_decontamination.decontaminate(single, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert set(texts(fair)) == {r.doc_id for r in marked.where("NOT contaminated").collect()} and fair.count() < single.count()
    assert {r.doc_id for r in packed.collect()} == set(texts(fair)) and packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= op5_packing.LENGTH


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, DATA).select("doc_id", "start").distinct().count() == stages[-1][1].count()


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rows = odd(spark).unionByName(docs(spark, ["some words here to be packed", "some words here to be packed"])).withColumn("score", F.lit("mine"))
    folder = saved(rows, tmp_path / "odd", "documents")
    saved(spark.createDataFrame([(4, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int"), folder, "labels")
    saved(spark.createDataFrame([(None, None), ("b", "")], "item_id string, text string"), folder, "benchmark")
    packed = corpus_pipeline.run(spark, folder).collect()
    # 5 is there twice, and 0 and 1 hold the same words.
    assert sorted((r.doc_id for r in packed if r.start == 0), key=str) == sorted([None, 0, 1, 2, 3, 4, 5, 6], key=str)
    empty = saved(rows.limit(0), tmp_path / "empty", "documents")
    for name in ("labels", "benchmark"):
        saved(spark.read.parquet(f"{folder}/{name}.parquet").limit(0), empty, name)
    assert corpus_pipeline.run(spark, empty).count() == 0
