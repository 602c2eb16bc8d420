"""Helpers of the operators."""

from types import SimpleNamespace

import pytest

from fieldlab.llm import common


def test_checkpoints_need_a_shared_folder():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError):
        common.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={}))


def test_batches_are_bounded_in_bytes(spark):
    common.small_batches(spark)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    got = spark.range(0, 5000, 1, 1).selectExpr("repeat('x', 3000) AS t").mapInArrow(run, "n long").collect()
    assert max(r.n for r in got) * 3000 < 2 * common.BATCH_BYTES and sum(r.n for r in got) == 5000


def test_cut_reads_small_results_by_few_tasks(spark):
    df = common.cut(spark.range(0, 1000, 1, 16), 300)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1000 and common.cut(spark.range(0), 300).count() == 0
