"""Versions that a crash leaves as they were, and batches that are written once to every sink."""

import pytest
from quorant.sources import versions


def rows(df):
    return sorted(r.id for r in df.collect())


def test_a_version_is_there_wholly_or_not(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.save_version(spark.range(3), path) == 1
    versions.write_data(spark.range(99), path)  # a run that stops between data and manifest
    assert rows(versions.read_version(spark, path)) == [0, 1, 2] and versions.versions(spark, path) == [1]
    pinned = versions.read_version(spark, path)
    assert versions.save_version(spark.range(5), path) == 2
    assert rows(pinned) == [0, 1, 2] and rows(versions.read_version(spark, path)) == list(range(5))
    assert versions.restore(spark, path, 1) == 3 and rows(versions.read_version(spark, path)) == [0, 1, 2]


def test_old_versions_go_and_what_is_named_stays(spark, tmp_path):
    path = str(tmp_path / "v")
    for i in range(1, 7):
        versions.save_version(spark.range(i), path)
    versions.restore(spark, path, 1)  # 7 is the data of 1
    versions.write_data(spark.range(99), path)
    assert versions.keep_versions(spark, path, 2, every=3) == [3, 6, 7]
    assert [len(rows(versions.read_version(spark, path, v))) for v in (3, 6, 7)] == [3, 6, 1]
    assert len(versions._Files(spark, path).names("data")) == 3
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, 2)


def test_a_batch_made_again_is_written_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).repartition(2).write.parquet(folder)
    broken = [True]

    def second(batch, key):
        if broken.pop() if broken else False:
            raise ConnectionError
        versions.to_files(f"{out}/b")(batch, key)

    for _ in range(3):
        stream = spark.readStream.schema("id long").parquet(folder)
        query = versions.fan_out(stream, {"a": versions.to_files(f"{out}/a", "json"), "b": second}, "q", str(tmp_path / "log"))
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001
            assert not broken
    for sink, kind in (("a", "json"), ("b", "parquet")):
        assert rows(versions.read_sink(spark, f"{out}/{sink}", "id long", kind)) == list(range(10))
