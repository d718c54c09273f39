"""Micro-batch forms of the jobs: what arrives is joined with what is stored, and state is kept by key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pressroom.functions.urls import url_hash
from pressroom.lineage import cut, drop
from pressroom.operators import clusters, dedup, sources
from pressroom.operators.sources import DEGRADED_AT, LEAST_MINUTES, MOST_MINUTES, PAUSED_AT


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files below a path or glob, `files` of them a batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run_once(query: DataFrame, checkpoint: str, per_batch=None, path: str | None = None, mode: str = "append") -> None:
    """Process what has arrived and stop: into `path`, or batch by batch through per_batch(df, id)."""
    _writer(query, checkpoint, per_batch, path, mode).trigger(availableNow=True).start().awaitTermination()


def _writer(query: DataFrame, checkpoint: str, per_batch, path: str | None, mode: str):
    writer = query.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(per_batch) if per_batch else writer.format("parquet").option("path", path)


@contextmanager
def _keyed_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which holds more than memory and is read by key."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_keyed(query: DataFrame, checkpoint: str, per_batch=None, path: str | None = None, mode: str = "append") -> None:
    """run_once for queries that keep state by key (exact_url_stream, source_states)."""
    with _keyed_state(query.sparkSession):
        run_once(query, checkpoint, per_batch, path, mode)


def run_steadily(query: DataFrame, checkpoint: str, per_batch=None, path: str | None = None, mode: str = "append", every: str = "60 seconds"):
    """Process what arrives, a batch at every interval, until the returned query is stopped."""
    with _keyed_state(query.sparkSession):
        return _writer(query, checkpoint, per_batch, path, mode).trigger(processingTime=every).start()


HISTORY = "crawl_date date, batch long"
#: A batch that brings more days than that, as a first one may, writes a folder for each month and not for each day.
MOST_DAYS = 100


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier batches wrote, with crawl_date and batch, which are folders; nothing before the first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    schema = f"{schema}, {HISTORY}"
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, batch: int, by_month: bool = False) -> None:
    """A batch has folders of its own below those of its days or months, which are named by their last day: when it is replayed, they are written anew and not twice.

    Rows are dealt out in order of time, so a folder is one file or a few, whatever the number of tasks.
    """
    day = F.to_date("crawled_at")
    dated = df.withColumns({"crawl_date": F.last_day(day) if by_month else day, "batch": F.lit(batch).cast("long")})
    dated = dated.repartitionByRange("crawled_at").sortWithinPartitions("crawl_date", "crawled_at")
    dated.write.partitionBy("crawl_date", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _before(spark: SparkSession, path: str, schema: str, batch: int, since: datetime | None) -> DataFrame:
    """What batches before this one wrote of articles after `since`; only folders of such days and batches are read."""
    stored = _stored(spark, path, schema).where(F.col("batch") < batch)
    if since is not None:
        stored = stored.where((F.col("crawl_date") >= F.lit(since.date())) & (F.col("crawled_at") > F.lit(since)))
    return stored.drop("crawl_date", "batch")


class _FirstOfUrl(StatefulProcessor):
    """The id of the first article of a URL."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(rows).sort_values(["crawled_at", "id"])
        known = self.first.get()[0] if self.first.exists() else None
        if known is None:
            self.first.update((int(frame["id"].iloc[0]),))
        first = frame["id"].iloc[0] if known is None else known
        same = pd.Series([first] * len(frame), dtype="Int64")
        if known is None:
            same.iloc[0] = None
        yield pd.DataFrame({"id": frame["id"].to_numpy(), "url_hash": key[0], "duplicate_of": same})

    def close(self) -> None:
        pass


def exact_url_stream(stream: DataFrame) -> DataFrame:
    """L1 of all that ever came, exact and without time limit: id, url_hash, duplicate_of; stream: id, url, crawled_at.

    The first article of every URL is state by key, so a batch reads the keys that it brings and nothing else, however much came before. Run it by run_keyed.
    """
    hashed = stream.select("id", "crawled_at", url_hash(F.col("url")).alias("url_hash"))
    keyed = hashed.where("url_hash IS NOT NULL").groupBy("url_hash")
    found = keyed.transformWithStateInPandas(_FirstOfUrl(), "id long, url_hash string, duplicate_of long", "Append", "None")
    return found.unionByName(hashed.where("url_hash IS NULL").select("id", "url_hash", F.lit(None).cast("long").alias("duplicate_of")))


def exact_url_within(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """L1 with bounded state: the first of the rows of one URL that come within `delay` of each other."""
    hashed = stream.withWatermark("crawled_at", delay).withColumn("url_hash", url_hash(F.col("url")))
    return hashed.dropDuplicatesWithinWatermark(["url_hash"])


ARTICLE = "id long, crawled_at timestamp, language string, title string, entities array<string>, embedding array<float>, dedup_level int, duplicate_of long"


def cascade_batches(path: str, days: int = 7, cosine: float = 0.85, centres: DataFrame | None = None, probes: int | None = None):
    """per_batch: L2 to L4 of new articles against themselves and the stored ones of the last days; writes ARTICLE, all with their verdicts.

    With centres (of vectors.train) L4 looks for similar vectors in cells instead of comparing all of a look-back; with `probes`, in that many only.
    """

    def per_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        given = [c.split()[0] for c in ARTICLE.split(", ")][:-2]
        new = cut(df.select(*given))  # read many times
        at = new.agg((F.min("crawled_at") - F.expr(f"INTERVAL {days} DAYS")).alias("first"), F.date_diff(F.max("crawled_at"), F.min("crawled_at")).alias("days")).first()
        first = at.first
        stored = _before(spark, path, ARTICLE, batch, first)
        everything = stored.select(*given).unionByName(new)
        # Duplicates that were decided earlier stay so and are nobody's original for L3 and L4.
        originals = stored.where("duplicate_of IS NULL").select(*given)
        ours = lambda pairs: pairs.join(new.select("id"), "id", "left_semi")
        l2 = ours(dedup.near_titles(everything))
        l4 = ours(dedup.similar_vectors(originals.unionByName(new), cosine, centres=centres, probes=probes))
        verdicts = dedup.cascade(new, l2, l4, before=originals)
        # Stored, as rows dealt out in order are looked at once more before.
        decided = cut(new.join(verdicts, "id").select(*given, "dedup_level", "duplicate_of"))
        _write(decided, path, batch, (at.days or 0) > MOST_DAYS)
        drop(new, decided)

    return per_batch


def stream_clusters(spark: SparkSession, path: str) -> DataFrame:
    """id, cluster of all articles that cascade_batches wrote."""
    return clusters.assign_clusters(_stored(spark, path, ARTICLE).select("id", "duplicate_of"))


STATE = "status string, errors int, idle int, minutes int, average double, count int"
STATE_OUT = "source_id long, status string, consecutive_errors int, days_without_new int, interval_minutes int, average_new double, crawl_count int"


def next_state(state: tuple, status: str, new: int, found: int, alpha: float = 0.3) -> tuple:
    """Health and frequency of a source after one more crawl."""
    health, errors, idle, minutes, average, count = state
    if status != "success":
        errors += 1
        if errors >= PAUSED_AT and health == "degraded":
            health = "paused"
        elif errors >= DEGRADED_AT and health == "active":
            health = "degraded"
        return health, errors, idle + 1, minutes, average, count
    rate = new / found if found > 0 else 0.0
    if rate > 0.5:
        minutes = max(LEAST_MINUTES, int(minutes * 0.7))
    elif rate <= 0:
        minutes = min(MOST_MINUTES, minutes * 2)
    elif rate <= 0.1:
        minutes = min(MOST_MINUTES, int(minutes * 1.5))
    average = float(new) if count <= 1 else alpha * new + (1 - alpha) * average
    return "active", 0, 0 if new > 0 else idle + 1, minutes, average, count + 1


class _SourceState(StatefulProcessor):
    """Health and frequency of a source; archived when it has had no log for so many days."""

    def __init__(self, first_interval: int, idle_days: int | None):
        self.start = ("active", 0, 0, first_interval, 0.0, 0)
        self.idle = None if idle_days is None else idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _row(self, key, now: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *now)], columns=[c.split()[0] for c in STATE_OUT.split(", ")])

    def _wait(self, last: pd.Timestamp) -> None:
        if self.idle is not None:
            for timer in [t if isinstance(t, int) else t[0] for t in self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.state.get()) if self.state.exists() else self.start
        logs = pd.concat(rows).sort_values(["started_at", "id"])
        for status, new, found in zip(logs["status"], logs["articles_new"].tolist(), logs["articles_found"].tolist(), strict=True):
            now = next_state(now, status, new, found)
        self.state.update(now)
        self._wait(logs["started_at"].iloc[-1])
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.state.get()) if self.state.exists() else self.start
        now = ("archived", *now[1:])
        self.state.update(now)
        yield self._row(key, now)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.state.update((str(row["status"]), int(row["errors"]), int(row["idle"]), int(row["minutes"]), float(row["average"]), int(row["count"])))
        self._wait(pd.Timestamp(row["last_at"]))

    def close(self) -> None:
        pass


def initial_states(logs: DataFrame, first_interval: int = 240) -> DataFrame:
    """source_id, STATE and last_at of every source after the logs so far, by the batch jobs: what source_states can go on from."""
    health, frequency = sources.health(logs), sources.frequency(logs, first_interval)
    last = logs.groupBy("source_id").agg(F.max("started_at").alias("last_at"))
    return health.join(frequency, "source_id", "left").join(last, "source_id").select(
        "source_id", "status", F.col("consecutive_errors").alias("errors"), F.col("days_without_new").alias("idle"), F.coalesce("interval_minutes", F.lit(first_interval)).alias("minutes"),
        F.coalesce("average_new", F.lit(0.0)).alias("average"), F.coalesce("crawl_count", F.lit(0)).alias("count"), "last_at",
    )


def source_states(logs: DataFrame, first_interval: int = 240, idle_days: int | None = None, late: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """STATE_OUT of every source with new logs (source_id, id, started_at, status, articles_new, articles_found), as of the batch. Run it by run_keyed, in update mode.

    Logs are expected in order from batch to batch, and are put in order within one. With idle_days, a source is archived when the
    logs of all have gone on for so long without one of its own, and logs that come later than `late` after newer ones are left out. With initial (of
    initial_states), sources go on from there.
    """
    mode = "None"
    if idle_days is not None:
        logs, mode = logs.withWatermark("started_at", late), "EventTime"
    given = None if initial is None else initial.groupBy("source_id")
    return logs.groupBy("source_id").transformWithStateInPandas(_SourceState(first_interval, idle_days), STATE_OUT, "Update", mode, given)


def daily_counts(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """The daily report as days close: window, crawls, new, avg_ms."""
    day = F.window("started_at", "1 day")
    counts = logs.withWatermark("started_at", late).groupBy(day).agg(F.count("*").alias("crawls"), F.sum("articles_new").alias("new"), F.avg("response_time_ms").alias("avg_ms"))
    return counts.select(F.to_date("window.start").alias("day"), "crawls", "new", F.round("avg_ms", 4).alias("avg_ms"))


def last_day_counts(articles: DataFrame, late: str = "1 hour") -> DataFrame:
    """Articles of the last 24 hours, every hour: until, articles. Hours are counted first, and the hours of a day summed, so an article is one row and not 24."""
    hours = articles.withWatermark("crawled_at", late).groupBy(F.window("crawled_at", "1 hour").alias("hour")).agg(F.count("*").alias("n"))
    span = F.window(F.window_time("hour"), "24 hours", "1 hour")
    return hours.groupBy(span).agg(F.sum("n").alias("articles")).select(F.col("window.end").alias("until"), "articles")


def on_time(items: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Items that are not late: undated, or newer than an hour before their source's last crawl; for streams, and without limit for each source."""
    from pressroom.operators.listings import incremental_filter

    return incremental_filter(items, sources, now, None)
