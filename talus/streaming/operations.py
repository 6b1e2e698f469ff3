"""Live tool-use events: operations, an append-only buffer, notices, session state, churn, alerts, and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import relational as R
from ..operators import similarity

EVENT = "session_id string, tool_name string, tool_input struct<file_path:string,old_string:string,new_string:string,content:string,command:string>, ts timestamp"
#: A file churns when its count first goes over this.
CHURN = 5
STATE = "ops int, edits int, writes int, files string"
UPDATE = "session_id string, ops int, edits int, writes int, distinct_files int, churn array<string>, extensions map<string,int>"


def events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of JSON event files in a folder."""
    return spark.readStream.schema(EVENT).json(path)


def operations(rows: DataFrame) -> DataFrame:
    """operation (edit, write, other), file, size and a preview of 80 characters of each event."""
    i = F.col("tool_input")
    op = F.when(F.col("tool_name") == "Edit", "edit").when(F.col("tool_name") == "Write", "write").otherwise("other")
    size = F.when(op == "edit", F.coalesce(F.length(i["new_string"]), F.lit(0)) - F.coalesce(F.length(i["old_string"]), F.lit(0))).when(op == "write", F.length(i["content"]))
    return rows.select("session_id", "ts", op.alias("operation"), i["file_path"].alias("file"), size.alias("size"), F.substring(F.coalesce(i["new_string"], i["content"], i["command"]), 1, 80).alias("preview"))


def append_buffer(stream: DataFrame, path: str, checkpoint: str):
    """Appends the stream to JSON files; the checkpoint makes each event count once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def buffer_statistics(buffer: DataFrame) -> DataFrame:
    return buffer.groupBy("session_id").agg(F.count("*").alias("operations"), F.countDistinct("file").alias("files"))


def notices(stream: DataFrame, every: int = 10, idle_ms: int | None = 86_400_000) -> DataFrame:
    """session_id, n for each multiple of every that a session's count of events passes. The count of a session that is idle for idle_ms starts again; None keeps it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = before = state.get[0] if state.exists else 0
        for b in batches:
            n += len(b)
        state.update((n,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        passed = list(range((before // every + 1) * every, n + 1, every))
        if passed:
            yield pd.DataFrame({"session_id": [key[0]] * len(passed), "n": passed})

    return stream.groupBy("session_id").applyInPandasWithState(run, "session_id string, n int", "n int", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def track(stream: DataFrame, churn: int = CHURN, idle_ms: int = 86_400_000) -> DataFrame:
    """The running state of each session after each micro-batch: counts, distinct files, files that have just begun to
    churn, and extensions. State of a session that is idle for idle_ms is dropped, so state is bounded by live sessions."""
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ops, edits, writes, raw = state.get if state.exists else (0, 0, 0, "{}")
        files = json.loads(raw)
        fresh = []
        for b in batches:
            ops += len(b)
            edits += int((b.operation == "edit").sum())
            writes += int((b.operation == "write").sum())
            for f in b.file.dropna():
                files[f] = files.get(f, 0) + 1
                if files[f] == churn + 1:
                    fresh.append(f)
        state.update((ops, edits, writes, json.dumps(files)))
        state.setTimeoutDuration(idle_ms)
        ext: dict[str, int] = {}
        for f in files:
            e = f.rpartition(".")[2] if "." in f.rpartition("/")[2] else ""
            ext[e] = ext.get(e, 0) + 1
        yield pd.DataFrame({"session_id": [key[0]], "ops": [ops], "edits": [edits], "writes": [writes], "distinct_files": [len(files)], "churn": [sorted(fresh)], "extensions": [ext]})

    return stream.groupBy("session_id").applyInPandasWithState(run, UPDATE, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def track_batch(ops: DataFrame, churn: int = CHURN) -> DataFrame:
    """What track() ends with, over a table."""
    each = ops.groupBy("session_id", "file").agg(F.count("*").alias("n"), F.count_if(F.col("operation") == "edit").alias("e"), F.count_if(F.col("operation") == "write").alias("w"))
    return each.groupBy("session_id").agg(F.sum("n").alias("ops"), F.sum("e").alias("edits"), F.sum("w").alias("writes"), F.count("file").alias("distinct_files"), F.sort_array(F.collect_list(F.when(F.col("n") > churn, F.col("file")))).alias("churn"))


def cached_fingerprints(spark: SparkSession, cache_path: str, before: int | None = None) -> DataFrame:
    """The newest fingerprint of each file of a cache that similarity_alerts() keeps; before: as it was when that batch began."""
    every = spark.read.parquet(cache_path)
    return R.last_wins(every if before is None else every.where(F.col("batch") < before), ["file"], "batch").drop("batch")


def similarity_alerts(changed: DataFrame, cache_path: str, alerts_path: str, checkpoint: str, least: float = 0.3):
    """For each micro-batch of changed files (file, source): alerts against the fingerprints cached so far.

    A batch adds the fingerprints of its own files under its number and touches no others; a batch that runs again writes
    the same again, and one that stops in between loses nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        similarity.fingerprints(batch.dropDuplicates(["file"])).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")
        prints = spark.read.parquet(f"{cache_path}/batch={number}")
        similarity.incremental(prints, cached_fingerprints(spark, cache_path, number), least).write.mode("overwrite").json(f"{alerts_path}/batch={number}")

    return changed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def tumbling(rows: DataFrame, width: str = "1 hour", late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums in windows of width; on a stream rows over late behind are left out."""
    df = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return df.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id") -> DataFrame:
    """Runs of a user's events without a gap."""
    df = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return df.groupBy(user, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def run_once(query) -> None:
    """Runs a stream writer over what is there, then stops.

    Without batches for time alone: a state that waits for its timeout would ask for another one forever.
    """
    conf, key = SparkSession.active().conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(key, before)
