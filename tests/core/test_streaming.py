"""A stream over files that has ended equals the batch result."""

from datetime import datetime, timedelta

from tessera.streaming import events as e


def test_streams_equal_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    path = f"{tmp_path}/events"
    df.repartition(3).write.parquet(path)
    batch = spark.read.parquet(path)
    key = lambda f: sorted(map(str, f.collect()))
    for k, f in enumerate((lambda x: e.tumbling(x, "1 hour", "3 days"), lambda x: e.sliding(x, "2 hours", "1 hour", "3 days"))):
        out = e.run_to_table(f(e.read_events(spark, path)), f"s{k}", f"{tmp_path}/c{k}", "complete")
        assert key(out) == key(f(batch))
    once = e.run_to_table(e.deduplicated(e.read_events(spark, path).union(e.read_events(spark, path)), "3 days"), "d", f"{tmp_path}/d")
    assert once.count() == 200
    assert e.sessions(batch, "20 minutes").count() > 3
