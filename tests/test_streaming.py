"""Streams that run to their present end."""

from datetime import datetime, timedelta

import pytest

from sparkassay.streaming import events as EV

_SCHEMA = "event_id long, ts timestamp, user_id long, value double"


@pytest.fixture
def folder(spark, tmp_path):
    """Three files of events, the last four of each repeated in the next one."""
    for k in range(3):
        rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 3, 1.0) for i in range(10 * k - 4 * (k > 0), 10 * k + 10)]
        spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_appended_rows_of_all_batches_are_read_from_files(spark, folder, tmp_path):
    ev = EV.read_stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=1)
    out = EV.drain(EV.distinct_events(ev).select("event_id"), str(tmp_path / "state"), "appended", "append")
    assert sorted(r.event_id for r in out.collect()) == list(range(30))
    assert out.columns == ["event_id"]
    assert out.inputFiles(), "the rows were held by the driver"


def test_a_stream_without_files_appends_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    schema = spark.createDataFrame([], _SCHEMA).schema
    out = EV.drain(EV.distinct_events(EV.read_stream(spark, str(tmp_path / "none"), schema)), str(tmp_path / "state"), "nothing", "append")
    assert out.count() == 0 and out.columns == schema.names


def test_a_complete_result_is_that_of_the_last_batch_in_files(spark, folder, tmp_path):
    ev = EV.read_stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=1)
    out = EV.drain(EV.sessions(ev, gap="5 minutes", late="2 hours"), str(tmp_path / "state"), "complete")
    expected = EV.sessions(spark.read.parquet(folder), gap="5 minutes").collect()
    assert sorted(out.collect()) == sorted(expected) and sum(r.n for r in expected) == 38
    assert out.columns == ["session_start", "user_id", "n", "total"]
    assert out.inputFiles(), "the result was held by the driver"
    assert len(list((tmp_path / "state-rows").iterdir())) == 1


def test_a_stream_without_files_has_an_empty_result(spark, tmp_path):
    (tmp_path / "none").mkdir()
    ev = EV.read_stream(spark, str(tmp_path / "none"), spark.createDataFrame([], _SCHEMA).schema)
    assert EV.drain(EV.sessions(ev, late="2 hours"), str(tmp_path / "state"), "empty").count() == 0
