"""Continuous forms: new files, edge upserts, the request limiter, event windows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.constants import RATE_LIMIT, RATE_WINDOW
from weftgraph.operators.store import merge_generations, merge_triples
from weftgraph.operators.tablelog import TableLog
from weftgraph.sources.files import parsed


def watch_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Stream of parsed files: each new file once; the checkpoint remembers which were seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return parsed(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "[!.]*").load(folder))


def limit_requests(rows: Iterable[tuple[float, int]], limit: int = RATE_LIMIT, window: float = RATE_WINDOW) -> list[bool]:
    """Whether each request in time order passes: rejected ones are not remembered; a limit of 0 or less passes all."""
    kept: list[float] = []
    out = []
    for at, _ in rows:
        kept = [t for t in kept if t >= at - window]
        ok = limit <= 0 or len(kept) < limit
        if ok:
            kept.append(at)
        out.append(ok)
    return out


def rate_limited(events: DataFrame, limit: int = RATE_LIMIT, window: float = RATE_WINDOW) -> DataFrame:
    """(user_id, event_id, allowed): the ordered fold per key; a key's requests are streamed in order, only its window is held.

    The fold depends on the order, so it runs in one sorted pass over
    partitions by key; batches may end inside a key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for b in batches:
            allowed = []
            for user, at in zip(b["user_id"], b["at"], strict=True):
                if user != key:
                    key, kept = user, []
                kept = [t for t in kept if t >= at - window]
                ok = limit <= 0 or len(kept) < limit
                if ok:
                    kept.append(at)
                allowed.append(ok)
            yield b[["user_id", "event_id"]].assign(allowed=allowed)

    rows = events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, "user_id long, event_id long, allowed boolean")


def rate_limit_stream(events: DataFrame, limit: int = RATE_LIMIT, window: float = RATE_WINDOW, late: str = "1 minute") -> DataFrame:
    """The limiter over a stream (user_id, event_id, ts): the window of each key is its state and goes when the watermark has passed it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"]:
            kept = [t for t in kept if t >= at - window]
            ok = limit <= 0 or len(kept) < limit
            if ok:
                kept.append(float(at))
            allowed.append(ok)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((rows["at"].max() + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[["user_id", "event_id"]].assign(allowed=allowed)

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_micros("ts") / 1e6)
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


EDGES = "kg_id long, subject string, rel_type string, object string, source_doc_id long, verb string, confidence long, created_at timestamp, updated_at timestamp, source_chunk_ids array<string>"


def edge_log(spark: SparkSession, path: str) -> TableLog:
    """The edge table that streams add to; `read("edges")` gives it merged."""
    return TableLog(spark, path, {"edges": (EDGES, merge_generations)})


def upsert_edges(triples: DataFrame, log: TableLog, checkpoint: str):
    """Start a stream that merges triple rows into the table `edges` of a log (`edge_log`, or a build's store).

    A batch writes the edges of its own rows and commits them under the
    stream's own id and the batch's number: one that is repeated after a
    failure is passed over, and other streams and builds add to the same table
    without losing anything. The id is the one that the checkpoint holds, so a
    stream that starts afresh is another writer.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        writer = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        if change := log.begin(writer, epoch):
            change.write("edges", merge_triples(batch))
            change.commit()
            log.compact("edges")

    return triples.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type; batch and stream alike (an addition of this library)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
