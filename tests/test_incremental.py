import datetime as dt

import pytest

from marlstone.operators.incremental import CHANGES, Conflict, StateStore, newest_listing, recorded_state, run_once, select_changed, with_hash

SCHEMA = "scope string, key string, hash string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_selects_new_and_changed_once(spark, tmp_path):
    store, done = StateStore(spark, f"file://{tmp_path}"), []
    work = lambda df: done.append(rows(df, "key", "change"))
    run_once(store, spark.createDataFrame([("v", "a", "1"), ("v", "b", "1")], SCHEMA), work)
    run_once(store, spark.createDataFrame([("v", "a", "1"), ("v", "b", "2"), ("v", "c", "1")], SCHEMA), work)
    run_once(store, spark.createDataFrame([("v", "a", "1"), ("v", "b", "2"), ("v", "c", "1")], SCHEMA), work)
    assert done == [[("a", "new"), ("b", "new")], [("b", "changed"), ("c", "new")], []]


def test_a_failed_run_leaves_the_state(spark, tmp_path):
    store, done = StateStore(spark, f"file://{tmp_path}"), []
    now = spark.createDataFrame([("v", "a", "1")], SCHEMA)

    def fail():
        raise OSError("lost")

    for point in ("work", "swap"):
        with pytest.raises(OSError):
            run_once(store, now, (lambda df: fail()) if point == "work" else (lambda df: None), fail if point == "swap" else None)
        assert store.version() is None
    run_once(store, now, lambda df: done.append(rows(df, "key")))
    assert done == [[("a",)]] and store.version()[0] == 1


def test_nulls_and_empty(spark):
    now = spark.createDataFrame([(None, "a", "1"), ("v", None, "1"), ("v", "b", None)], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    assert select_changed(now, none).count() == 3
    assert select_changed(now, now).count() == 0
    assert select_changed(none, now).count() == 0


def test_listing_and_recorded_state(spark):
    t = dt.datetime(2025, 1, 1)
    files = spark.createDataFrame([("v", 1, t, "old.md", "x", 1), ("v", 2, t, "a.md", "AA", 1), ("v", 2, t + dt.timedelta(1), "a.md", "bb", 2)], "vault string, scan_no int, listed_at timestamp, path string, content_hash string, key int")
    assert rows(newest_listing(files), "scope", "path", "hash") == [("v", "a.md", "bb")]
    runs = spark.createDataFrame([(9, "v", "ok", t), (3, "v", "ok", t + dt.timedelta(2)), (4, "v", "failed", t + dt.timedelta(3))], "run_id long, vault string, status string, generated_at timestamp")
    hashes = spark.createDataFrame([(3, ".\\x\\a.md", "AB"), (9, "b.md", "1"), (4, "c.md", "1"), (3, "n.md", None)], "run_id long, path string, content_hash string")
    assert rows(recorded_state(runs, hashes), "key", "hash") == [("x/a.md", "ab")]


def test_of_two_racing_commits_one_wins(spark, tmp_path):
    import threading

    at, wait, won, lost = f"file://{tmp_path}", threading.Barrier(2), [], []
    first = StateStore(spark, at)
    first.commit(spark.createDataFrame([("v", "a", "1")], SCHEMA))

    def run(key):
        try:
            won.append((key, run_once(StateStore(spark, at), spark.createDataFrame([("v", key, "1")], SCHEMA), None, wait.wait)))
        except Conflict:
            lost.append(key)

    threads = [threading.Thread(target=run, args=(k,)) for k in ("b", "c")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == len(lost) == 1 and won[0][1] == 2 and [n for n, _ in first.versions()] == [1, 2]
    assert rows(first.changes(CHANGES), "key", "version") == [(won[0][0], 2)]
    # a commit follows the version that was read, though another came in between
    late = StateStore(spark, at)
    late.read(SCHEMA)
    StateStore(spark, at).commit(spark.createDataFrame([("v", "d", "1")], SCHEMA))
    with pytest.raises(Conflict):
        late.commit(spark.createDataFrame([], SCHEMA))
    assert first.prune(1) == 2 and first.read(SCHEMA).count() == 1


def test_a_failure_after_the_work_repeats_nothing(spark, tmp_path):
    store, now = StateStore(spark, f"file://{tmp_path}"), spark.createDataFrame([("v", "a", "1"), ("v", "b", "1")], SCHEMA)

    def fail():
        raise OSError("lost")

    with pytest.raises(OSError):
        run_once(store, now, lambda df: df.count(), fail)
    run_once(store, now)
    run_once(store, now)
    assert rows(store.changes(CHANGES), "key", "version") == [("a", 1), ("b", 1)]


def test_rows_are_hashed_by_what_they_hold(spark):
    df = spark.createDataFrame([("v", "a", "x", None), ("v", "b", "", None), ("v", "c", None, None)], "scope string, key string, text string, n int")
    was = with_hash(df, "text", "n")
    now = with_hash(df.withColumn("text", df.text).replace("x", "y", "text"), "text", "n")
    assert rows(select_changed(now, was), "key", "change") == [("a", "changed")]
    assert was.select("hash").distinct().count() == 3
