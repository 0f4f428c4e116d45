"""Downloads as a stream with a state for each item: its attempts, when the next one is due, and dead letters."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from vecatlas.operators.ingest import PUBLIC_BASE, RateLimited

EVENTS = "id int, status string, attempts int, url string, error string"
STATE = "source string, status string, attempts int, due long"
DONE, RETRY, LIMITED, DEAD = "done", "retry", "limited", "dead"


def wait_ms(item: int, attempts: int, first: float, longest: float) -> int:
    """Milliseconds to the next attempt: doubled with each one, up to ``longest`` seconds, and spread by a hash so that items don't come back together."""
    spread = 0.75 + zlib.crc32(f"{item}:{attempts}".encode()) % 1000 / 2000
    return max(1, int(1000 * spread * min(longest, first * 2.0 ** min(attempts - 1, 60))))


def attempted(queue: DataFrame, fetcher: Callable[[str], bytes], store: Callable[[str, bytes], None], *, most: int = 5, first: float = 60.0, longest: float = 3600.0, base: str = PUBLIC_BASE) -> DataFrame:
    """A stream of events (id, status, attempts, url, error) from a stream of ``id`` and ``primaryImage``.

    An item is tried when it arrives and, after an error, when its timer ends; ``most`` attempts make it a dead letter. Its state stays, so
    an item that arrives again is not fetched again; a dead one is, if it arrives with another address. After RateLimited, the
    rest of the task's items of the batch wait for their timers too, and none of these counts as an attempt. Rows with a null id
    or a null or empty address are left out; of several new addresses in one batch the least counts.
    """

    def run():
        limited: list[str] = []  # of this task and batch

        def step(key, frames, state):
            (item,) = key
            item, now = int(item), state.getCurrentProcessingTimeMs()
            source, status, attempts, due = state.get if state.exists else (None, None, 0, 0)
            came = [a for pdf in frames for a in pdf["source"].tolist() if a != source]
            if came and status in (None, DEAD):
                source, status, attempts, due = min(came), RETRY, 0, now
            if status in (DONE, DEAD):
                return
            if due > now:  # it came again while its timer runs
                state.setTimeoutDuration(due - now)
                return
            error = limited[0] if limited else None
            if limited:
                status = LIMITED
            else:
                try:
                    store(f"artworks/{item}.jpg", fetcher(source))
                    status, attempts = DONE, attempts + 1
                except RateLimited as e:
                    status, error = LIMITED, f"RateLimited: {e}"
                    limited.append("RateLimited: not tried")
                except Exception as e:
                    attempts, error = attempts + 1, f"{type(e).__name__}: {e}"
                    status = DEAD if attempts >= most else RETRY
            if status in (RETRY, LIMITED):
                pause = wait_ms(item, max(1, attempts), first, longest)
                due = now + pause
                state.setTimeoutDuration(pause)
            state.update((source, status, attempts, due))
            yield pd.DataFrame({"id": [item], "status": [status], "attempts": [attempts], "url": [f"{base}/artworks/{item}.jpg" if status == DONE else None], "error": [error]})

        return step

    rows = queue.select("id", F.col("primaryImage").alias("source")).where("id is not null and source <> ''")
    return rows.groupBy("id").applyInPandasWithState(run(), EVENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def download_job(
    spark: SparkSession, inbox: str, results: str, checkpoint: str, fetcher: Callable[[str], bytes], store: Callable[[str, bytes], None], *, every: str = "10 seconds", files_per_batch: int = 100, **options
) -> StreamingQuery:
    """Download what files of ``id`` and ``primaryImage`` in ``inbox`` name, and keep the events in ``results`` by micro-batch.

    New files are new items; timers run in batches without any. A job that was killed goes on from its checkpoint: a batch that
    was not finished is repeated and replaces its own events, so an item has each of its attempts once in the results. The
    bytes of such a batch may be fetched once more; they are stored under the same key.
    """
    rows = spark.readStream.schema("id int, primaryImage string").option("maxFilesPerTrigger", files_per_batch).parquet(inbox)

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results}/batch={number}")

    events = attempted(rows, fetcher, store, **options)
    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def events_of(spark: SparkSession, results: str) -> DataFrame:
    """All events with the number of their micro-batch."""
    return spark.read.schema(f"{EVENTS}, batch int").parquet(results)


def outcomes(events: DataFrame) -> DataFrame:
    """Each item's last event."""
    last = F.max_by(F.struct("status", "attempts", "url", "error"), "batch").alias("last")
    return events.groupBy("id").agg(last).select("id", "last.*")


def wait_until_settled(query: StreamingQuery, spark: SparkSession, results: str, *, pause: float = 1.0, timeout: float = 3600.0) -> bool:
    """Wait until no file is new and no timer runs, then stop the job; False if ``timeout`` seconds were not enough."""
    end = time.monotonic() + timeout
    settled, repeated = False, None
    while not settled and time.monotonic() < end:
        if query.awaitTermination(pause):  # raises what the job died of
            break
        if not (past := query.recentProgress):
            continue
        if repeated is None:
            repeated = past[0]["batchId"]  # the first batch may be one of before, planned without the newest files
        if past[-1]["batchId"] > repeated and past[-1]["numInputRows"] == 0:
            settled = outcomes(events_of(spark, results)).where(F.col("status").isin(RETRY, LIMITED)).isEmpty()
    query.stop()
    return settled
