import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldlab.llm import op12_block_naming as op

from .common_cases import docs, odd, saved
from .test_line_dedup import lower


def brute(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t or ""), []).append(i)
    return {i: (g[-1], len(g), i == g[-1], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def found(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def texts(seed):
    """Texts of few characters, so blocks and pairs recur in other places, and of up to 40 blocks."""
    rng = random.Random(seed)
    out = ["".join(rng.choice("aAbé\n") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 120]))) for _ in range(120)]
    return out + [out[rng.randrange(120)].upper() if rng.random() < 0.3 else out[rng.randrange(120)] for _ in range(60)] + [None, "", "ab" * 60, "ab" * 60, "ab" * 59 + "ba"]


@pytest.mark.parametrize("size", [3, 1024])
def test_equals_brute_force(spark, size):
    every = texts(size)
    assert found(op.exact_groups(docs(spark, every, kept="mine", name="x", level="y").repartition(3), size=size)) == brute(every)


def test_colliding_hashes_get_another_seed(spark, monkeypatch):
    seeds, true = [], op.hashed

    def weak(block, seed):
        seeds.append(seed)
        return F.struct((F.octet_length(block) % 2).cast("long").alias("a"), F.lit(0).cast("long").alias("b")) if seed < 2 else true(block, seed)

    monkeypatch.setattr(op, "hashed", weak)
    every = texts(9)[:60]
    assert found(op.exact_groups(docs(spark, every), size=4)) == brute(every) and max(seeds) == 2


def test_odd_rows(spark):
    got = op.exact_groups(odd(spark)).collect()
    same = [r for r in got if r.doc_id == 5]
    assert len(got) == 8 and [r.keep_id for r in same] == [5, 5] and sorted(r.kept for r in same) == [False, True]
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {2} and [r.kept for r in got if r.doc_id is None] == [True]
    assert op.exact_groups(docs(spark, ["a"]).limit(0)).count() == 0


def test_native_plan(spark):
    plan = op.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_its_sql(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = op.query(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(op.ORACLE).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
    assert op.query(spark, saved(docs(spark, []), tmp_path, "documents")).count() == 0
