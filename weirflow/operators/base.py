"""What the marts stand on: the enriched log and the current state as tables bucketed by id, extended by new days only.

A day's rows need no more of the past than each id's last observation, which the state has, and the last positive scores of each
platform, a small table of their own. So an extension reads the new days, the state and that table, appends to the log, and
merges the new days' state with the old one: joins by id of tables with the same buckets need no exchange, and no mart builds
the log again. Tables live in the session's warehouse, which all executors share."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.config import DEFAULTS, Thresholds
from weirflow.operators.state import FIRST, LAST, LAST_KNOWN, fold, kept, only_when_moved
from weirflow.operators.windows import scored, with_normalised_blocked, with_velocity


@dataclass(frozen=True)
class Base:
    """Names of the tables, their number of buckets, and the last day they hold."""

    name: str
    buckets: int
    days: date | None = None
    version: int = 0

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.table(f"{self.name}_log")

    def state(self, spark: SparkSession) -> DataFrame:
        return spark.table(f"{self.name}_state_{self.version}")

    def scores(self, spark: SparkSession) -> DataFrame:
        return spark.table(f"{self.name}_scores_{self.version}")


def new_base(rows: int, rows_a_bucket: int = 2_000_000, least: int = 8) -> Base:
    """An empty base with buckets for a log of about that many rows."""
    return Base(f"base_{uuid.uuid4().hex}", max(least, -(-rows // rows_a_bucket)))


def enriched_after(new: DataFrame, base: Base, t: Thresholds = DEFAULTS) -> DataFrame:
    """Velocity, normalised and trending score of new observations, as if all before them were there."""
    spark, columns = new.sparkSession, new.columns
    rows = new.withColumn("_old", F.lit(False))
    if base.days:
        last = base.state(spark).select("id", F.col("last_updated_at").alias("captured_at"), "raw_score", "comment_count", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("_old"))
        rows = rows.unionByName(last, allowMissingColumns=True)
    rows = with_velocity(rows, t).where(~F.col("_old")).drop("_old").withColumn("_turn", F.lit(0).cast("long"))
    if base.days:
        rows = rows.unionByName(base.scores(spark), allowMissingColumns=True)
    rows = with_normalised_blocked(rows, t, first="_turn").where("_turn = 0")
    return scored(rows.select(*columns, "score_velocity", "comment_velocity", "normalised_score"), t)


def merged_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of two spans of time, ``new`` all after ``old``: one join by id."""
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    later = [F.when(n("id").isNotNull(), n(c)).otherwise(o(c)).alias(c) for c in LAST]
    return old.alias("o").join(new.alias("n"), "id", "full").select(
        "id", *[F.when(o("first_seen_at").isNotNull(), o(c)).otherwise(n(c)).alias(c) for c in FIRST], *later, *[F.coalesce(n(c), o(c)).alias(c) for c in LAST_KNOWN],
        F.coalesce(o("first_seen_at"), n("first_seen_at")).alias("first_seen_at"), F.coalesce(n("last_updated_at"), o("last_updated_at")).alias("last_updated_at"),
    )


def extended(base: Base, log: DataFrame, t: Thresholds = DEFAULTS) -> Base:
    """The base with the days of ``log`` after its last one; earlier days are not looked at. The log is written last, and the old
    version's state goes after that, so a fault on the way leaves the old version whole."""
    spark = log.sparkSession
    rows = log if base.days is None else log.where(F.col("captured_at") >= F.date_add(F.lit(base.days), 1))
    new = kept(enriched_after(rows, base, t).repartition(base.buckets, "id"))
    last = new.agg(F.max(F.to_date("captured_at"))).first()[0]
    if last is None and base.version:
        return base
    after = replace(base, days=last, version=base.version + 1)
    bucketed = lambda df: df.repartition(base.buckets, "id").write.bucketBy(base.buckets, "id").format("parquet")
    state = fold(only_when_moved(new))
    bucketed(merged_state(base.state(spark), state) if base.days else state).saveAsTable(f"{base.name}_state_{after.version}")
    positive = new.where("raw_score > 0").select("platform", "captured_at", "seq", "raw_score", F.lit(0).cast("long").alias("_turn"))
    both = positive.unionByName(base.scores(spark)) if base.days else positive
    newest = F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("_turn"), F.desc("captured_at"), F.desc("seq")))
    scores = both.withColumn("_place", newest).where(F.col("_place") <= t.window_rows)
    scores.withColumn("_turn", (-F.col("_place")).cast("long")).drop("_place").write.format("parquet").saveAsTable(f"{base.name}_scores_{after.version}")
    bucketed(new).mode("append").saveAsTable(f"{base.name}_log")
    if base.version:
        for table in ("state", "scores"):
            spark.sql(f"DROP TABLE {base.name}_{table}_{base.version}")
    return after
