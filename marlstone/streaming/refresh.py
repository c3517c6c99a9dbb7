"""Refreshing from a stream of changes: upserts by key, debounced sessions, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import StateStore, latest, merged_state, select_changed


def changes(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def debounced(events: DataFrame, key: str, ts: str, gap: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    """key, start, end, n of bursts of changes that a pause of the gap has ended."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def refresh(stream: DataFrame, store: StateStore, out: str, checkpoint: str):
    """Each batch selects what is new or changed against the state, writes it under the batch's number and swaps the state.

    A batch that is repeated after a failure finds its number written and the state swapped or not; either way nothing is lost or doubled.
    Rows: scope, key, hash, at.
    """

    def batch(df: DataFrame, number: int) -> None:
        now = latest(df, ["scope", "key"], [F.col("at")]).select("scope", "key", "hash")
        state = store.read("scope string, key string, hash string")
        select_changed(now, state).write.mode("overwrite").parquet(f"{out}/batch={number}")
        # a stream brings changes, not whole scopes: rows of other keys stay
        kept = state.join(now.select("scope", "key"), ["scope", "key"], "left_anti")
        store.commit(kept.unionByName(now))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: files, bytes and a checksum that doesn't depend on their order; equal fingerprints need no new run."""
    said = F.concat_ws("|", "path", F.coalesce(F.col("size").cast("string"), F.lit("-")), F.coalesce(F.unix_micros("mtime").cast("string"), F.lit("-")))
    row = F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(row).cast("string").alias("mark"))


__all__ = ["changes", "debounced", "fingerprint", "merged_state", "refresh"]
