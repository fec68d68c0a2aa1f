"""Change detection over arrival feeds: Structured Streaming in place of a polling loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "path string, generation long, change string, sha256 string, at timestamp"
_STATE = "sha256 string, generation long"


def content_changes(feed: DataFrame) -> DataFrame:
    """R-01, R-06: (path, generation, change, sha256, at) whenever a path's content identity differs from its last one.

    ``feed`` streams (path, sha256, at).  Touches without a new identity are no
    change; a null identity is a removal.  A path's arrivals of one micro-batch
    come in several Arrow batches where they are many, and are put in the order
    of their times together.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, generation = state.get if state.exists else (None, 0)
        rows = []
        arrived = pd.concat([batch[["at", "sha256"]] for batch in batches]).sort_values(["at", "sha256"])
        for r in arrived.itertuples(index=False):
            new = None if pd.isna(r.sha256) else r.sha256
            if new != last:
                generation += 1
                rows.append((key[0], generation, "added" if last is None else "removed" if new is None else "changed", new, r.at))
                last = new
        state.update((last, generation))
        yield pd.DataFrame(rows, columns=["path", "generation", "change", "sha256", "at"])

    return feed.groupBy("path").applyInPandasWithState(step, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def debounced(changes: DataFrame, quiet: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """R-02: bursts of changes of a project as one row each, once they have been quiet for a while."""
    return changes.withWatermark("at", late).groupBy("project", F.session_window("at", quiet).alias("burst")).agg(F.count(F.lit(1)).alias("changes")).select("project", F.col("burst.start").alias("began"), F.col("burst.end").alias("ended"), "changes")


def without_repeats(feed: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """R-07: each event once, however often it arrives within the watermark."""
    return feed.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


def windowed_metrics(feed: DataFrame, by: list[str], value: str, window: str = "1 day", slide: str | None = None, late: str = "1 hour", expected: int | None = None) -> DataFrame:
    """R-08: exact sums and counts for each window, given out when the watermark has passed its end.

    A window with another number of rows than expected, or with a value
    missing, is an error and has no mean.
    """
    grouped = feed.withWatermark("at", late).groupBy(F.window("at", window, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.expr(f"try_sum(cast({value} as decimal(24,12)))").alias("total"))
    error = F.when(F.lit(expected).isNotNull() & (F.col("n") != F.lit(expected)), "RECORD_COUNT").when(F.col("nulls") > 0, "INVALID_NUMBER")
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total", F.when(error.isNull(), F.col("total").cast("double") / F.col("n")).alias("mean"), error.alias("error"))


#: What ``verdict_states`` needs as ``spark.sql.streaming.stateStore.providerClass``: timers and maps by key live in RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICTS = "project string, generation long, state string, at timestamp, changes long"


class _Watch(StatefulProcessor):
    """One project's watch: what it last knew of each path, the burst that is open, and the checks begun so far.

    What is known is a log of (path, content), null for a removal, of which the
    last entry of a path counts.  It is read and appended to as a whole once for
    each micro-batch that has rows of the project, as a call for each row costs
    more than the row; it is written anew when half of it is outdated.
    """

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watch = handle.getValueState("watch", "generation long, due long, changes long, began long")
        self.known = handle.getListState("known", "path string, sha256 string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The rows of one key in one micro-batch, in the order of their times.
        batch = pd.concat(list(rows)).sort_values(["at", "path", "sha256"], na_position="last")
        seen = self.watch.exists()
        generation, due, changes, began = self.watch.get() if seen else (0, None, 0, None)
        logged, known, fresh = 0, {}, {}
        for path, content in self.known.get() if seen else ():
            logged += 1
            known[path] = content
        old, out = due, []
        for r in batch.itertuples(index=False):
            at = r.at.value // 1_000_000
            if due is not None and at >= due:
                generation += 1
                out.append((key[0], generation, "running", due, changes))
                due, changes = None, 0
            if pd.isna(r.path):
                out.append((key[0], generation, "stopped", at, changes))
                due, changes = None, 0
                continue
            new = None if pd.isna(r.sha256) else r.sha256
            if new == known.get(r.path):
                continue
            known[r.path] = fresh[r.path] = new
            if due is None:
                began = at
                out.append((key[0], generation, "pending", at, 0))
            due, changes = max(due or 0, at + self.quiet), changes + 1
        if old != due:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
        if logged and logged + len(fresh) > 2 * len(known):
            live = [(path, content) for path, content in known.items() if content is not None]
            self.known.put(live) if live else self.known.clear()
        elif fresh:
            self.known.appendList(list(fresh.items()))
        self.watch.update((generation, due, changes, began))
        yield _verdict_rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, due, changes, began = self.watch.get()
        out = []
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], generation + 1, "running", due, changes))
            self.watch.update((generation + 1, None, 0, began))
        yield _verdict_rows(out)

    def close(self) -> None:
        pass


def _verdict_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["project", "generation", "state", "at", "changes"])
    return out.astype({"generation": "int64", "changes": "int64"}).assign(at=pd.to_datetime(out["at"].astype("int64"), unit="ms"))


def verdict_states(feed: DataFrame, quiet_ms: int = 500, late: str = "1 minute") -> DataFrame:
    """R-01 to R-04, R-06, W-15: (project, generation, state, at, changes): the states that a project's verdict goes through.

    ``feed`` streams (project, path, sha256, at); a row without path stops the
    watch.  ``pending`` when a path's content first differs, which makes the
    verdict unknown; ``running``, with the next generation and the number of
    changes in the burst, once nothing has changed for ``quiet_ms`` (an event
    time timer, so out-of-order rows within ``late`` count); ``stopped`` at the
    end.  Content that is known already, as in a replayed batch, changes
    nothing.  A consumer runs the check of a ``running`` row (see ``publish``).
    """
    timed = feed.withWatermark("at", late)
    return timed.groupBy("project").transformWithStateInPandas(statefulProcessor=_Watch(quiet_ms), outputStructType=VERDICTS, outputMode="Append", timeMode="EventTime")


def _mark(identities: DataFrame) -> tuple:
    """One row that changes with any path's identity, whatever the order."""
    each = F.xxhash64("path", "sha256").cast("decimal(38,0)")
    return tuple(identities.agg(F.count(F.lit(1)), F.sum(each), F.sum(F.hash("path", "sha256").cast("long"))).first())


def publish(identities: Callable[[], DataFrame], check: Callable[[DataFrame], DataFrame], target: str) -> Callable[[DataFrame, int], None]:
    """R-03, R-04: a ``foreachBatch`` function that checks what changed and writes the verdict of each generation.

    The inputs' identities are read before and after the check.  If they
    differ, the result is dropped and the generation is written as pending with
    WATCH_PENDING, which is an unknown; the change itself brings the next batch.
    A batch that runs again, as it may after a failure, replaces its own
    generation's folder.
    """

    def run(batch: DataFrame, generation: int) -> None:
        batch.persist()
        try:
            before = _mark(identities())
            result = check(batch).withColumns({"generation": F.lit(generation), "state": F.lit("current")})
            result.drop("generation").write.mode("overwrite").parquet(f"{target}/results/generation={generation}")
            state, code = ("current", None) if before == _mark(identities()) else ("pending", "WATCH_PENDING")
            batch.sparkSession.createDataFrame([(state, code)], "state string, error string").coalesce(1).write.mode("overwrite").parquet(f"{target}/verdicts/generation={generation}")
        finally:
            batch.unpersist()

    return run


def reusable(wanted: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R-05: (what is known, what is to be computed) of (kind, input_fingerprint); errors are never reused."""
    good = memo.where("error is null")
    key = ["kind", "input_fingerprint"]
    return wanted.join(good, key), wanted.join(good.select(*key), key, "left_anti")
