from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.streaming import increments as I

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string"


@pytest.fixture
def folder(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts", "event_type")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path, events


def test_latest_rows_are_kept(spark, folder):
    path, events = folder
    q = I.keep_latest(I.landed(spark, str(path / "in"), SCHEMA, 1), str(path / "store"), str(path / "log"), ["user_id"], [F.col("ts"), F.col("event_id")])
    q.awaitTermination()
    want = {}
    for r in events.collect():
        want[r["user_id"]] = max(want.get(r["user_id"], (r["ts"], -1)), (r["ts"], r["event_id"]))
    kept = lambda: {r["user_id"]: r["event_id"] for r in I.latest_rows(spark, str(path / "store"), events.schema).collect()}
    assert kept() == {u: e for u, (_, e) in want.items()}
    assert I.drop_unused(spark, str(path / "store")) > 0 and I.drop_unused(spark, str(path / "store")) == 0
    assert kept() == {u: e for u, (_, e) in want.items()}


def test_a_batch_writes_only_the_buckets_it_touches_and_may_run_twice(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(u, e, None, "t") for u, e in x], SCHEMA)
    store = str(tmp_path / "store")
    assert I.latest_rows(spark, store, rows().schema).count() == 0
    for k, batch in enumerate([rows((1, 1), (2, 1), (3, 1)), rows((2, 5)), rows()]):
        batch.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for log in ("a", "b"):  # the second query starts anew: its batches have the same numbers and are written again
        I.keep_latest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")), store, str(tmp_path / log), ["user_id"], [F.col("event_id")]).awaitTermination()
        assert sorted((r["user_id"], r["event_id"]) for r in I.latest_rows(spark, store, rows().schema).collect()) == [(1, 1), (2, 5), (3, 1)]
    assert len(list((tmp_path / "store/rows/v0").glob("bucket=*"))) == 3 and len(list((tmp_path / "store/rows/v1").glob("bucket=*"))) == 1


def test_incomplete_batches_fail(spark, folder):
    path, _ = folder
    seen = []
    q = I.gated(I.landed(spark, str(path / "in"), SCHEMA), str(path / "log"), lambda b: False, lambda b, n: seen.append(n))
    with pytest.raises(Exception, match="not complete"):
        q.awaitTermination()
    assert not seen


def test_streamed_windows_equal_those_of_the_table(spark, folder):
    path, events = folder
    q = I.tumbling(I.landed(spark, str(path / "in"), SCHEMA), late="60 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(path / "log")).start()
    q.awaitTermination()
    rows = lambda df: Counter((r["begins"], r["event_type"], r["n"]) for r in df.collect())
    assert rows(spark.table("tumbled")) == rows(I.tumbling(events))
