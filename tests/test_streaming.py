import datetime as dt

from marlstone.operators.incremental import StateStore
from marlstone.streaming.refresh import changes, refresh


def test_stream_refresh(spark, tmp_path):
    schema = "scope string, key string, hash string, at timestamp"
    t = dt.datetime(2025, 1, 1)
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    store = StateStore(spark, f"file://{tmp_path}/state")

    def run():
        refresh(changes(spark, f"{tmp_path}/in/*", schema), store, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()

    put("a", [("v", "x", "1", t), ("v", "y", "1", t)])
    run()
    put("b", [("v", "x", "1", t), ("v", "y", "2", t + dt.timedelta(1))])
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.batch, r.key, r.change) for r in out.collect()) == [(0, "x", "new"), (0, "y", "new"), (1, "y", "changed")]
