import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import blobs, common, rolling


def test_batches_are_cut_by_bytes_and_rows_stay_whole():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 5, "d" * 5, "e" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    parts = list(common.byte_batches([batch, batch.slice(0, 0)], 30))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 30 for p in parts)


@pytest.mark.parametrize("values", [[], [0], [255, 256, 3], [1 << 63, 5], [0, 0]])
def test_planes_give_the_values_back(values):
    values = np.array(values, np.uint64)
    assert (blobs.unplanes(blobs.planes(values)) == values).all()
    assert (blobs.least_type(values) == values).all()
    assert all((a == b).all() if isinstance(a, np.ndarray) else a == b for a, b in zip(blobs.unsqueeze(blobs.squeeze(values, "x", 7)), (values, "x", 7)))


def test_rolling_hashes_are_equal_for_equal_bytes_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 400, dtype=np.uint8)
    sums = rolling.prefix(data)
    for n in (1, 2, 5, 12):
        at = np.arange(len(data) - n + 1)
        hashes = rolling.spans(sums, at, at + n)
        by_bytes = {}
        for i, h in zip(at, hashes.tolist()):
            assert by_bytes.setdefault(data[i : i + n].tobytes(), h) == h
        assert len(set(by_bytes.values())) == len(by_bytes)


def test_the_owners_batch_size_stays(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.range(3)
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        common.small_batches(df)
        assert spark.conf.get(name) == "1000"
        spark.conf.set(name, "77")
        common.small_batches(df)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, before)


def test_parts_follow_the_size_of_files(spark, tmp_path):
    spark.range(1000).selectExpr("id", "repeat(sha2(string(id), 512), 8) AS text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert common.shuffle_partitions(df) == 4
    assert common.shuffle_partitions(df, 1000) > 50
    assert common.shuffle_partitions(spark.createDataFrame([(1,)], "a int").unionAll(spark.createDataFrame([(2,)], "a int"))) >= 4
