"""Incremental forms of the batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import logs
from ..operators.arena import INITIAL, INITIAL_RD, INITIAL_VOL, rate


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def append_batch(path: str, key: str | None = "clip_id", clean: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of unknown keys are appended (with key None, all rows).

    Each batch has a folder of its own, written anew if the batch is tried again, so nothing doubles.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = clean(batch)
        spark = batch.sparkSession
        mine = f"batch={number}"
        if key is not None:
            new = new.dropDuplicates([key])
            if _exists(spark, path):
                known = spark.read.schema(new.schema).option("basePath", path).parquet(path)
                new = new.join(known.filter(~F.contains(F.col("_metadata.file_path"), F.lit(f"/{mine}/"))).select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/{mine}")

    return write


def ingest(source: DataFrame, path: str, checkpoint: str, key: str | None = "clip_id", clean: Callable[[DataFrame], DataFrame] = lambda d: d, once: bool = True) -> StreamingQuery:
    """Stream new rows (embeddings, captions, trajectories) into a table; resumes where it stopped."""
    w = source.writeStream.foreachBatch(append_batch(path, key, clean)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 minutes")).start()


def finite_trajectories(batch: DataFrame) -> DataFrame:
    """Clips without NaN positions."""
    return batch.filter(~F.exists("frames", lambda p: F.isnan(p["x"]) | F.isnan(p["y"])))


def label_counters(events: DataFrame) -> DataFrame:
    """(project, key, label_type, change: +1 or -1) stream -> running counts, for update or complete output."""
    return events.groupBy("project", "key").agg(
        F.sum(F.when(F.col("label_type") == "manual", F.col("change")).otherwise(0)).alias("n_manual"),
        F.sum(F.when(F.col("label_type") == "autolabel", F.col("change")).otherwise(0)).alias("n_autolabel"),
    )


_RATING = "arena string, criterion string, model string, rating double, rd double, vol double, n int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ratings(StatefulProcessor):
    """A map of model states, of which a batch reads and writes the ones it meets, and a map of match ids that time out."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.models = handle.getMapState("models", "model string", "rating double, rd double, vol double, n int")
        self.seen = handle.getMapState("seen", "match string", "one boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("id", kind="stable")
        states: dict[str, tuple] = {}
        touched = set()
        for match, a, b, winner in zip(batch["match_id"], batch["model_a"], batch["model_b"], batch["winner"], strict=True):
            if self.seen.containsKey((match,)):
                continue
            self.seen.updateValue((match,), (True,))
            if winner == "skip" or a == b:
                continue
            for m in (a, b):
                if m not in states:
                    states[m] = tuple(self.models.getValue((m,))) if self.models.containsKey((m,)) else (INITIAL, INITIAL_RD, INITIAL_VOL, 0)
            x, y = states[a], states[b]
            new_a, new_b = rate(x[:3], y[:3], winner)
            states[a], states[b] = (*new_a, x[3] + 1), (*new_b, y[3] + 1)
            touched |= {a, b}
        for m in touched:
            self.models.updateValue((m,), states[m])
        yield pd.DataFrame([(*key, m, *states[m]) for m in sorted(touched)], columns=["arena", "criterion", "model", "rating", "rd", "vol", "n"])

    def close(self) -> None:
        pass


def live_ratings(votes: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Votes stream -> the states of both models after each vote, per (arena, criterion), for update output.

    A (match, criterion) counts once. Votes of one micro-batch go by id. With ``keep_ms`` a match id is forgotten that long after it
    came, so the state stays as large as the models and the votes of that time, and a repetition later than that would count
    again; ``start_ratings`` starts such a stream. Needs the RocksDB state store, which it sets for the session.
    """
    votes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    v = votes.select("arena", "criterion", "id", "match_id", "model_a", "model_b", "winner")
    mode = "none" if keep_ms is None else "processingTime"
    return v.groupBy("arena", "criterion").transformWithStateInPandas(_Ratings(keep_ms), _RATING, "update", mode)


def start_ratings(votes: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, keep_ms: int = 7 * 86_400_000, once: bool = True) -> StreamingQuery:
    """Start ``live_ratings`` with bounded state; ``write`` gets each batch of changed states and its number.

    Batches without votes are off for this query alone: with a clock in the state, Spark would plan one after another
    and a run until now would never end. State that has timed out goes with later batches.
    """
    conf, name = votes.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        w = live_ratings(votes, keep_ms).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()
    finally:
        conf.set(name, before)


def manifests(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """A stream of manifest files as they arrive."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 100).json(folder)


def live_sessions(logins: DataFrame, hours: int = 72) -> DataFrame:
    """(username, at) stream -> first login of each user within the time to live; state older than that is dropped."""
    return logins.withWatermark("at", f"{hours} hours").dropDuplicatesWithinWatermark(["username"])


def log_counts(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Log files stream -> records per day and kind; days close when the watermark has passed them."""
    r = logs.parse(spark.readStream.text(folder)).withWatermark("ts", late)
    return r.groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")
