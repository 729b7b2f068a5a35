"""The same operators on streams: sources, routing by topic, windowed buckets, keyed velocity, de-duplication; and, with tables
carried from batch to batch, rolling baselines, token buckets, late rows, and several sinks that become visible together."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from weirflow.config import DEFAULTS, Thresholds
from weirflow.operators import throttle
from weirflow.operators.state import kept, merge_partitions, passing, removed, shared_folder
from weirflow.operators.topics import exploded, merge_buckets, topic_buckets
from weirflow.operators.windows import with_normalised_blocked


def read_files(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(path)


def read_kafka(spark: SparkSession, servers: str, topics: list[str], offsets_a_batch: int | None = 50) -> DataFrame:
    """Values of the topics from the earliest offset, as text, for ``records_of`` (needs the connector's package on the cluster)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
    reader = reader.option("maxOffsetsPerTrigger", offsets_a_batch) if offsets_a_batch else reader
    return reader.load().select("topic", F.col("value").cast("string").alias("value"), "timestamp")


#: What the wire gives a batch: at most this many rows, every so many seconds.
ROWS_A_BATCH, SECONDS_A_BATCH = 50, 2.0


def records_of(messages: DataFrame, schemas: dict[str, str], topic: str = "topic", value: str = "value") -> DataFrame:
    """``messages`` with the record of their topic's schema in a column of the topic's name (dots as underscores), null in the
    others: one pass over the wire, whatever the topics. Text that is no record leaves its column null; messages of no listed topic
    are left out."""
    parsed = {t.replace(".", "_"): F.when(F.col(topic) == t, F.from_json(F.col(value), schema)) for t, schema in schemas.items()}
    return messages.where(F.col(topic).isin(list(schemas))).withColumns(parsed)


def run_every(work: Carried, place: str, seconds: float = SECONDS_A_BATCH):
    """The stream's query, a batch every ``seconds`` until it is stopped; started again, it goes on after its last batch."""
    writer = work.stream.writeStream.option("checkpointLocation", f"{place}/stream").trigger(processingTime=f"{int(seconds * 1000)} milliseconds")
    return writer.foreachBatch(batches(work, place)).start()


def topic_windows(rows: DataFrame, late: str = "2 hours", minutes: int = 15, at: str = "captured_at") -> DataFrame:
    """Tumbling buckets per topic and platform; rows later than ``late`` are left to a batch backfill."""
    felt = F.when(F.col("sentiment_compound") != 0, F.col("sentiment_compound"))
    spread = exploded(rows.withWatermark(at, late))
    return spread.groupBy("topic", "platform", F.window(at, f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("signal_count"), F.sum(felt).alias("sentiment_sum"), F.count(felt).alias("sentiment_n"), F.sum("raw_score").alias("total_score")
    ).select("topic", "platform", F.col("w.start").alias("bucket"), "signal_count", "sentiment_sum", "sentiment_n", "total_score")


def sliding_topics(rows: DataFrame, late: str = "2 hours", width: str = "2 hours", step: str = "15 minutes", at: str = "captured_at") -> DataFrame:
    """Signals and platforms of a topic over a sliding look-back; the few platforms are counted exactly, as a set."""
    return exploded(rows.withWatermark(at, late)).groupBy("topic", F.window(at, width, step).alias("w")).agg(F.count("*").alias("signals"), F.size(F.collect_set("platform")).cast("long").alias("platforms"))


def hourly(rows: DataFrame, key: str, late: str = "4 hours", at: str = "captured_at") -> DataFrame:
    """The continuous hourly rollup."""
    return rows.withWatermark(at, late).groupBy(key, F.window(at, "1 hour").alias("w")).agg(F.avg("raw_score").alias("avg_score"), F.max("raw_score").alias("max_score"), F.count("*").alias("snapshots")).select(key, F.col("w.start").alias("hour"), "avg_score", "max_score", "snapshots")


def without_repeats(rows: DataFrame, keys: list[str], within: str = "25 hours", at: str = "captured_at") -> DataFrame:
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def velocities(rows: DataFrame, late: str = "25 hours", ttl: int = DEFAULTS.ttl_seconds) -> DataFrame:
    """Velocity per id with the last observation as state. Rows are ordered by (time, seq) inside a batch; a row older than
    the state gets velocity 0 and is not stored; state past the TTL is cleared by the event-time timer."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        part = pd.concat(list(parts)).sort_values(["captured_at", "seq"])
        last = state.get if state.exists else None
        out = []
        for r in part.itertuples(index=False):
            now = r.captured_at.value / 1e9
            gap = now - last[0] if last else None
            moves = gap is not None and 0 <= gap <= ttl
            per = (lambda a, b: (a - b) / max(gap, 1.0)) if moves else (lambda a, b: 0.0)
            out.append((r.seq, r.id, per(r.raw_score, last[1] if last else 0), per(r.comment_count, last[2] if last else 0)))
            if gap is None or gap >= 0:
                last = (now, r.raw_score, r.comment_count)
        state.update(last)
        state.setTimeoutTimestamp(max(int(last[0] * 1000) + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["seq", "id", "score_velocity", "comment_velocity"])

    source = rows.select("seq", "id", "captured_at", "raw_score", "comment_count").withWatermark("captured_at", late)
    return source.groupBy("id").applyInPandasWithState(step, "seq long, id string, score_velocity double, comment_velocity double", "at double, score long, comments long", "append", GroupStateTimeout.EventTimeTimeout)


#: Tables by name.
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Carried:
    """A stream whose batches need what earlier ones left: ``step(rows, state)`` gives the tables that a batch adds to the sinks and
    the state after it. The state is a few small tables that the step names, absent before the first batch."""

    stream: DataFrame
    step: Callable[[DataFrame, Tables], tuple[Tables, Tables]]


def existing(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def batches(work: Carried, place: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with a batch: every sink's rows and every state table are written under the batch's number, and last the
    batch's line in the manifest. Sinks are read through the manifest, so a batch shows in all of them or in none; a batch that is
    run again after a fault reads the state before it, and replaces whatever it had written."""

    def run(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = f"{place}/state/batch={number - 1}"
        names = [r["name"] for r in spark.read.parquet(f"{before}/names").collect()] if existing(spark, f"{before}/names") else []
        rows = rows.persist()
        try:
            with passing(spark):  # all that a step gives is written before the batch ends
                sinks, state = work.step(rows, {n: spark.read.parquet(f"{before}/{n}") for n in names})
                for name, table in sinks.items():
                    table.write.mode("overwrite").parquet(f"{place}/{name}/batch={number}")
                for name, table in state.items():
                    table.write.mode("overwrite").parquet(f"{place}/state/batch={number}/{name}")
            spark.createDataFrame([(n,) for n in state], "name string").coalesce(1).write.mode("overwrite").parquet(f"{place}/state/batch={number}/names")
            spark.createDataFrame([(n,) for n in sinks], "sink string").coalesce(1).write.mode("overwrite").parquet(f"{place}/manifest/batch={number}")
            if number > 1:
                removed(spark, f"{place}/state/batch={number - 2}")  # only the last batch can be run again
        finally:
            rows.unpersist()

    return run


def visible(spark: SparkSession, place: str, sink: str) -> DataFrame:
    """A sink's rows, with their batch: of the batches that the manifest lists, and of no other."""
    done = spark.read.parquet(f"{place}/manifest").where(F.col("sink") == sink).select("batch")
    return spark.read.parquet(f"{place}/{sink}").join(F.broadcast(done), "batch")  # a row a batch


def carry(work: Carried, place: str) -> None:
    """All that is there now, through the stream, into the sinks under ``place``."""
    query = work.stream.writeStream.option("checkpointLocation", f"{place}/stream").trigger(availableNow=True).foreachBatch(batches(work, place)).start()
    query.awaitTermination()


def normalised(rows: DataFrame, late: str = "25 hours", t: Thresholds = DEFAULTS) -> Carried:
    """normalised_score per platform, in the order in which batches come and by (time, seq) inside a batch. A batch meets the last
    ``window_rows`` positive scores of each platform, a table that it renews; baselines come from sums over blocks, so no task and
    no state holds a platform's batch. A row without a score scores 0. ``late`` has no effect: no row is dropped."""
    columns = ("seq", "platform", "captured_at", "raw_score")

    def step(batch: DataFrame, state: Tables) -> tuple[Tables, Tables]:
        new = batch.select(*columns, F.lit(0).cast("long").alias("turn"))
        both = kept(new.unionByName(state["last"].select(*columns, "turn")) if state else new)
        scored = with_normalised_blocked(both, t, first="turn").where("turn = 0")
        newest = F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("turn"), F.desc("captured_at"), F.desc("seq")))
        last = both.where("raw_score > 0").withColumn("place", newest).where(F.col("place") <= t.window_rows)
        return {"out": scored.select("seq", "platform", "normalised_score")}, {"last": last.select(*columns, (-F.col("place")).cast("long").alias("turn"))}

    return Carried(rows.select(*columns), step)


def throttled(rows: DataFrame, rates: dict[str, float], late: str = "25 hours", burst_seconds: float = 3.0) -> Carried:
    """Rows that a bucket of each platform lets through, inside a batch by (time, seq); a row older than the batches before refills
    nothing. What is carried is a level and a time for each rate. No rate or a negative one lets all through."""

    def step(batch: DataFrame, state: Tables) -> tuple[Tables, Tables]:
        old = {r["platform"]: (r["level"], r["at"]) for r in state["buckets"].collect()} if state else {}  # a row a rate
        through, buckets = throttle.metered(batch, rates, burst_seconds=burst_seconds, state=old)
        now = {r["platform"]: (r["level"], r["at"]) for r in buckets.collect()}
        left = [(p, *v) for p, v in (old | now).items()]
        return {"out": through.select("seq", "platform")}, {"buckets": batch.sparkSession.createDataFrame(left, "platform string, level long, at long")}

    return Carried(rows.select("seq", "platform", "captured_at"), step)


def buckets_with_late(rows: DataFrame, late_seconds: int = 7200, minutes: int = 15) -> Carried:
    """Topic buckets that close: a bucket is open until the watermark (latest time seen less ``late_seconds``) passes its end. Open
    ones are carried as partial aggregates; a bucket is written to ``closed`` once, when it closes. Rows of a bucket that had closed
    before their batch, and those without a time, go aside to ``late``, whole; ``backfilled`` puts them where they belong."""
    end = F.unix_micros("bucket") + minutes * 60_000_000

    def step(batch: DataFrame, state: Tables) -> tuple[Tables, Tables]:
        mark = state["mark"].first()["mark"] if state else None
        at = F.floor(F.unix_micros("captured_at") / (minutes * 60_000_000)) * (minutes * 60_000_000) + minutes * 60_000_000
        behind = F.col("captured_at").isNull() | (at <= mark if mark is not None else F.lit(False))
        fresh = topic_buckets(batch.where(~behind), minutes)
        now = merge_buckets(state["open"], fresh) if state else fresh
        seen = batch.agg(F.max(F.unix_micros("captured_at"))).first()[0]
        mark = max(x for x in (mark, None if seen is None else seen - late_seconds * 1_000_000, -(2**62)) if x is not None)
        now = kept(now)
        return {"closed": now.where(end <= mark), "late": batch.where(behind)}, {"open": now.where(end > mark), "mark": batch.sparkSession.createDataFrame([(mark,)], "mark long")}

    return Carried(rows, step)


def last_state(spark: SparkSession, place: str, name: str) -> DataFrame:
    """A state table after the last batch that the manifest lists."""
    number = spark.read.parquet(f"{place}/manifest").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{place}/state/batch={number}/{name}")


def backfilled(spark: SparkSession, table: str, late: DataFrame, minutes: int = 15) -> None:
    """Adds late rows to the bucket table (partitioned by ``bucket_date``): summed to partial aggregates, merged with the partitions
    of the days they fall on, and only these are replaced. To be run once for a set of late rows."""
    new = kept(topic_buckets(late.where("captured_at IS NOT NULL"), minutes).withColumn("bucket_date", F.to_date("bucket")))
    days = new.select("bucket_date").distinct()
    stored = spark.read.parquet(table)
    touched = stored.join(days, "bucket_date", "left_semi").select(*[c for c in new.columns if c != "bucket_date"])
    merge_partitions(kept(merge_buckets(touched, new.drop("bucket_date")).withColumn("bucket_date", F.to_date("bucket"))), table, "bucket_date")


def published(messages: DataFrame, unify: Callable[[DataFrame], DataFrame]) -> Carried:
    """Each message to the raw channel of its platform and, unified, to the one channel of all; trending ones to the live channel,
    as a short line. ``unify`` makes signals (with ``is_trending``) of a batch's messages (platform, value); what it drops stays in
    the raw channel."""

    def step(batch: DataFrame, state: Tables) -> tuple[Tables, Tables]:
        signals = kept(unify(batch))
        raw = batch.select(F.concat("platform", F.lit(".raw")).alias("topic"), "value")
        unified = signals.select(F.lit("signals.normalised").alias("topic"), "id", "platform", F.to_json(F.struct(*signals.columns)).alias("value"))
        return {"raw": raw, "unified": unified, "push": signals.where("is_trending").select("id", pushed(signals).alias("value"))}, {}

    return Carried(messages, step)


LIVE_FIELDS = ("id", "title", "author", "trending_score", "raw_score", "comment_count", "score_velocity")


def pushed(signals: DataFrame) -> Column:
    """The line that the live channel gets of a signal: what it has of the live fields."""
    return F.to_json(F.struct(*[c for c in LIVE_FIELDS if c in signals.columns]))


def routed(messages: DataFrame, lists: dict[str, str], topic: str = "topic") -> DataFrame:
    """Messages with the name of the work list of their topic; those of no listed topic are left out."""
    pairs = F.create_map(*[F.lit(x) for pair in lists.items() for x in pair])
    return messages.withColumn("list", F.element_at(pairs, F.col(topic))).where(F.col("list").isNotNull())


def two_sinks(batch: Callable[[DataFrame, int], None], push: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One micro-batch, computed once, to the store and to the live channel; both see the batch's number, so a rerun of
    the batch replaces what it wrote."""

    def both(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            batch(rows, number)
            push(rows.where("is_trending").select(pushed(rows).alias("value")), number)
        finally:
            rows.unpersist()

    return both


def scratch(spark: SparkSession) -> str:
    """A new folder in the place all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame | Carried, keys: list[str], mode: str = "update", partitions: int | None = None) -> DataFrame:
    """All that is there now, through the stream: each micro-batch's rows are written under its number, and the last row of a
    key is its result. A batch run twice overwrites itself. Of a carried stream: the rows of its sink ``out``. What the stream needed
    to go on is removed at its end; the rows stay."""
    if isinstance(stream, Carried):
        spark = stream.stream.sparkSession
        place = scratch(spark)
        carry(stream, place)
        for done in ("stream", "state"):
            removed(spark, f"{place}/{done}")
        return visible(spark, place, "out").drop("batch")
    spark = stream.sparkSession
    place = scratch(spark)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    removed(spark, f"{place}/state")
    rows = spark.read.schema(StructType([*stream.schema.fields, *StructType.fromDDL("batch long").fields])).parquet(f"{place}/out")
    if mode == "append":
        return rows.drop("batch")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")
