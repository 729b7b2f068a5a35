"""Current state and history: upsert folds, dimension keys, retention, incremental writers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a signal keeps from its first observation, takes from its last, and takes from the last that has it.
FIRST = ("platform", "source_id", "title", "author", "community_id", "normalised_score")
LAST = ("raw_score", "comment_count", "topics")
LAST_KNOWN = ("score_velocity", "comment_velocity", "trending_score", "sentiment_compound")


def only_when_moved(rows: DataFrame, persist_unmoved: bool = False) -> DataFrame:
    """Velocities and trending score are stored only for rows that moved, unless asked otherwise."""
    if persist_unmoved:
        return rows
    moved = (F.col("score_velocity") != 0) | (F.col("comment_velocity") != 0)
    return rows.withColumns({c: F.when(moved, F.col(c)) for c in ("score_velocity", "comment_velocity", "trending_score")})


def fold(rows: DataFrame, first: tuple[str, ...] = FIRST, last: tuple[str, ...] = LAST, known: tuple[str, ...] = LAST_KNOWN) -> DataFrame:
    """One row an id: the upsert of all its observations, in any number of batches. Mergeable: aggregates only, no sort."""
    order = F.struct("captured_at", "seq")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return rows.groupBy("id").agg(
        *[F.min_by(c, order).alias(c) for c in first], *[F.max_by(c, order).alias(c) for c in last], *[latest(c) for c in known],
        F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_updated_at"),
    )


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def set_features(state: DataFrame, features: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """``columns`` of the state set from the matching feature row, where one exists."""
    new = features.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = state.join(new, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*state.columns)


def metrics_history(rows: DataFrame, persist_unmoved: bool = False) -> DataFrame:
    """Snapshots to append: rows that moved (or all), with their sequence number, which tells rows of one time apart."""
    kept = rows if persist_unmoved else rows.where("score_velocity <> 0 OR comment_velocity <> 0")
    return kept.select("id", "captured_at", "seq", "raw_score", "comment_count", "score_velocity", "comment_velocity", "trending_score", "sentiment_compound")


def retained(rows: DataFrame, now: Column, days: int = 90, at: str = "captured_at") -> DataFrame:
    return rows.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine's only where the executors are threads of it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return place or tempfile.mkdtemp(prefix="spark-shared-")


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, for several readers, in the folder that all executors share."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return noted(rows.checkpoint())


#: Folders of the checkpoints made so far inside the innermost ``passing`` of this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def noted(rows: DataFrame) -> DataFrame:
    """``rows``, which were just checkpointed, noted where a ``passing`` will remove them."""
    made = _made.get()
    if made is not None:
        folder = rows._jdf.queryExecution().logical().rdd().getCheckpointFile()
        made.extend([folder.get()] if folder.isDefined() else [])
    return rows


def removed(spark: SparkSession, folder: str) -> None:
    """The folder and all in it are gone, wherever it lies; one that is not there is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Checkpoints that this thread makes inside are removed at the end, after a fault too. What is read later has to be written
    or ``settled`` by then. Gives the list of their folders; other threads' checkpoints are not in it."""
    made: list[str] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)
        for folder in made:
            removed(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, kept, and nothing else: the checkpoints made on the way to it are removed, so a job of many steps leaves
    one copy of each step's result and not all that the step wrote."""
    with passing(spark) as made:
        rows = kept(make())
        made[:] = made[:-1]
    return noted(rows)


def write_history(rows: DataFrame, path: str) -> None:
    """Append snapshots, partitioned by UTC day."""
    rows.withColumn("captured_date", F.to_date("captured_at")).write.mode("append").partitionBy("captured_date").parquet(path)


def merge_partitions(new: DataFrame, path: str, partition: str) -> None:
    """Replace just the partitions that ``new`` holds."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
