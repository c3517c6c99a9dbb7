"""Only what is new or changed since the last run that succeeded.

State is one row per scope (a vault's profile) and key with the hash of the content (``with_hash``). ``select_changed`` joins the
current rows with the state on (scope, key) and keeps those without a row or with another hash. ``StateStore`` keeps versions of the
state as tables in a folder; a run reads the newest, writes the next one beside it, and publishes it in one atomic step. A run that
fails before that step leaves the state, so the next run selects the same records again; what a run published is never selected again.

Defined cases: a null scope, key or hash is a value of its own (null-safe comparison); a row with a null hash is selected unless the
state has a null hash for it; several current rows of one key count once (the last by ``order``, ties by the larger hash); an empty
state selects all rows, an empty input none.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fs, lookup, need, table, temporary

#: Spellings of one path differ in the separator and a leading "./".
LEADING = r"^(\./)+"


def path_key(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), LEADING, "")


def content_hash(*columns: Column) -> Column:
    """Of the columns' values and types, nulls apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def with_hash(df: DataFrame, *content: str) -> DataFrame:
    """df with ``hash`` made here from the content columns: rows are compared by what they hold, not by what was said of them."""
    return df.withColumn("hash", content_hash(*(F.col(c) for c in content)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that is last by order. Partial aggregation, so a hot key is no hot task; ties are broken by all columns."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def select_changed(current: DataFrame, state: DataFrame, scope: str = "scope", key: str = "key", hash_: str = "hash") -> DataFrame:
    """Rows of current whose (scope, key) the state lacks or has with another hash, with ``change``: 'new' or 'changed'.

    One shuffle join on (scope, key): both are spread evenly even if one scope has a third of all rows. State rows repeated for a key
    count as recorded if any of them has the hash.
    """
    known = need(state, scope, key, hash_).select(F.col(scope).alias("_s"), F.col(key).alias("_k"), F.col(hash_).alias("_h")).groupBy("_s", "_k").agg(
        F.collect_set(F.coalesce(F.concat(F.lit("="), "_h"), F.lit("null"))).alias("_hashes")
    )
    on = F.col(f"c.{scope}").eqNullSafe(F.col("_s")) & F.col(f"c.{key}").eqNullSafe(F.col("_k"))
    mine = F.coalesce(F.concat(F.lit("="), F.col(f"c.{hash_}")), F.lit("null"))
    joined = current.alias("c").join(known, on, "left")
    return joined.where(F.col("_hashes").isNull() | ~F.array_contains("_hashes", mine)).select(
        "c.*", F.when(F.col("_hashes").isNull(), "new").otherwise("changed").alias("change")
    )


class StateStore:
    """Versions of the state in a folder, and a pointer to each.

    A version is a number and a token. Its tables are written under the token, where no other run looks, and are published by one atomic
    step: the pointer file named by the number alone comes to be, with the token in it, if there is none of that name. So of two runs
    that began from one version exactly one publishes the next; the other's ``commit`` raises Conflict and its tables stay unseen.
    ``read`` remembers the version it gave: a commit follows the version that was read, not one that came in between.

    Needs a folder whose rename refuses an existing file (HDFS and stores like it), or a file system with hard links (local, NFS).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._base: int | None = None

    def versions(self) -> list[tuple[int, str]]:
        """Number and token of all versions, oldest first."""
        system, p = fs(self.spark, f"{self.folder}/_versions")
        if not system.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(p))
        return [(int(n), self._token(n)) for n in names if n.isdigit()]

    def _token(self, name: str) -> str:
        system, p = fs(self.spark, f"{self.folder}/_versions/{name}")
        stream = system.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> tuple[int, str] | None:
        system, p = fs(self.spark, f"{self.folder}/_versions")
        names = sorted(n for n in (s.getPath().getName() for s in system.listStatus(p)) if n.isdigit()) if system.exists(p) else []
        return (int(names[-1]), self._token(names[-1])) if names else None

    def read(self, schema: str) -> DataFrame:
        """The committed state, or an empty one. The next commit follows the version given here."""
        at = self.version()
        self._base = at[0] if at else 0
        return self.spark.createDataFrame([], schema) if at is None else self.spark.read.schema(schema).parquet(f"{self.folder}/state-{at[1]}")

    def changes(self, schema: str) -> DataFrame:
        """What all published runs selected, with ``version``. Records of a run that failed are not in it, whatever the run had written."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/changes-{t}").withColumn("version", F.lit(n)) for n, t in self.versions() if self._has(f"changes-{t}")]
        empty = self.spark.createDataFrame([], f"{schema}, version int")
        return reduce(DataFrame.unionByName, parts, empty)

    def _has(self, name: str) -> bool:
        system, p = fs(self.spark, f"{self.folder}/{name}")
        return bool(system.exists(p))

    def commit(self, state: DataFrame, fail: Callable[[], None] | None = None, token: str | None = None) -> int:
        """Swaps in the state. ``fail`` (tests) runs between the write and the swap. ``token`` names what the run has written already."""
        if self._base is None:
            now = self.version()
            self._base = now[0] if now else 0
        number, token = self._base + 1, token or uuid.uuid4().hex
        state.write.parquet(f"{self.folder}/state-{token}")
        if fail:
            fail()
        self._publish(number, token)
        self._base = number
        return number

    def _publish(self, number: int, token: str) -> None:
        system, folder = fs(self.spark, f"{self.folder}/_versions")
        system.mkdirs(folder)
        draft, to = f"{self.folder}/_draft-{token}", f"{self.folder}/_versions/{number:012d}"
        _, at = fs(self.spark, draft)
        out = system.create(at, False)
        out.write(bytearray(token.encode()))
        out.close()
        try:
            if system.getUri().getScheme() == "file":
                # a local rename would replace a pointer that is there; a hard link can't
                local = lambda x: self.spark.sparkContext._jvm.java.io.File(fs(self.spark, x)[1].toUri().getPath()).getPath()
                try:
                    os.link(local(draft), local(to))
                except FileExistsError:
                    raise Conflict(number) from None
            elif not system.rename(at, fs(self.spark, to)[1]):
                raise Conflict(number)
        finally:
            system.delete(at, False)

    def prune(self, keep: int = 2) -> int:
        """Deletes the state tables of all but the newest versions (what they selected stays) and says how many."""
        old = [t for _, t in self.versions()[: -max(1, keep)] if self._has(f"state-{t}")]
        for t in old:
            system, p = fs(self.spark, f"{self.folder}/state-{t}")
            system.delete(p, True)
        return len(old)


class Conflict(RuntimeError):
    """Another run committed this version first: the run must be repeated."""

    def __init__(self, number: int):
        super().__init__(f"another run committed version {number} first; this one must be repeated")


def merged_state(state: DataFrame, current: DataFrame, scope: str = "scope", key: str = "key", hash_: str = "hash") -> DataFrame:
    """The state after a run over current: its rows win, keys of scopes it covers but no longer has are gone, other scopes stay."""
    cols = [scope, key, hash_]
    covered = current.select(F.col(scope).alias("_s")).distinct()
    kept = state.join(covered, F.col(scope).eqNullSafe(F.col("_s")), "left_anti").select(*cols)
    return kept.unionByName(current.select(*cols).distinct())


def newest_listing(source_files: DataFrame) -> DataFrame:
    """Of each vault the newest scan, and of each path in it the latest listing: vault, path (as listed), key, hash."""
    rows = need(source_files, "vault", "scan_no", "listed_at", "path", "content_hash")
    newest = rows.groupBy("vault").agg(F.max("scan_no").alias("_newest"))
    here = rows.join(lookup(newest), "vault").where(F.col("scan_no") == F.col("_newest"))
    here = here.select("vault", path_key(F.col("path")).alias("key"), "listed_at", "path", F.lower("content_hash").alias("hash"))
    return latest(here, ["vault", "key"], [F.col("listed_at")]).select(F.col("vault").alias("scope"), "key", "hash", "path")


def recorded_state(export_runs: DataFrame, manifest_hashes: DataFrame) -> DataFrame:
    """The state that the newest successful run of each vault left: scope, key, hash. Runs that failed recorded nothing that counts."""
    ok = need(export_runs, "run_id", "vault", "status", "generated_at").where((F.col("status") == "ok") & F.col("generated_at").isNotNull())
    newest = ok.groupBy("vault").agg(F.max_by("run_id", F.struct("generated_at", "run_id")).alias("run_id"))
    rows = need(manifest_hashes, "run_id", "path", "content_hash")
    known = rows.join(lookup(newest), "run_id").where(F.col("content_hash").isNotNull())
    return known.select(F.col("vault").alias("scope"), path_key(F.col("path")).alias("key"), F.lower("content_hash").alias("hash"))


CHANGES = "scope string, key string, hash string, change string"


def run_once(store: StateStore, current: DataFrame, work: Callable[[DataFrame], None] | None = None, fail: Callable[[], None] | None = None) -> int:
    """One run: select, write what was selected under the run's token, work on it, publish it together with the new state.

    If anything fails before the swap, state and published changes are as before and the next run selects the same records again; after
    it they are never selected again. What counts as done is what ``store.changes`` has, so a record is in it once even if ``work`` saw
    it in a run that failed: work with effects of its own should name them by what it is given, not by the time.
    """
    state, token = store.read("scope string, key string, hash string"), uuid.uuid4().hex
    to = f"{store.folder}/changes-{token}"
    select_changed(current.select("scope", "key", "hash"), state).write.parquet(to)
    if work:
        work(store.spark.read.schema(CHANGES).parquet(to))
    return store.commit(merged_state(state, current), fail, token)


def p5_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vault, path, change for the next run of every vault. A file's content is known by what its listing says of it, which is hashed on both sides."""
    state = recorded_state(table(spark, sf_dir, "export_runs"), table(spark, sf_dir, "manifest_hashes"))
    # the recorded hashes become the first version of the state, as a run of this engine would have left it
    store = StateStore(spark, temporary(spark, "state"))
    store.commit(with_hash(state, "hash"))
    current = with_hash(newest_listing(table(spark, sf_dir, "source_files")), "hash")
    changed = select_changed(current, store.read("scope string, key string, hash string"))
    return changed.select(F.col("scope").alias("vault"), "path", "change")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_changed(spark, sf_dir).select("vault", "path").distinct()
