"""Dense numbers, surrogate keys and running sums of ordered rows, where one key may hold any share of them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.state import kept


def same(pairs: dict[str, str]) -> Column:
    """Columns equal, nulls too."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs.items()])


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "number") -> DataFrame:
    """``rows`` with their number from 1 inside their keys (inside the table if there are none). Rows are dealt by ranges of
    (keys, order), so a key lies in as many tasks as its rows fill; counts of these ranges (a row a key and range) give the
    offsets, and ranks are taken inside a range alone. Ranges come from a sample, so the dealt rows are written before anything
    is counted. Rows equal in keys and order stand next to each other, in no defined order."""
    ranged = kept(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    of = {c: f"_of_{c}" for c in (*keys, "_range")}
    offsets = counts.select(*[F.col(c).alias(o) for c, o in of.items()], F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = ranged.withColumn("_inside", inside).join(offsets, same(of)).withColumn(name, F.col("_before") + F.col("_inside"))
    return out.select(*rows.columns, name)


def running(rows: DataFrame, key: str, place: str, sums: dict[str, str], block: int = 1024) -> DataFrame:
    """``rows`` with running sums of columns (name of the sum: column) by ``place`` (numbers from 1, no gaps) inside the key:
    inside blocks of places first, then with the sums of the key's blocks before, so a task holds ``block`` rows of a key."""
    blocked = rows.withColumn("_block", F.floor((F.col(place) - 1) / block))
    totals = blocked.groupBy(key, "_block").agg(*[F.sum(c).alias(f"_{s}") for s, c in sums.items()])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("_of_key"), F.col("_block").alias("_of_block"), *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums])
    inside = Window.partitionBy(key, "_block").orderBy(place)
    out = blocked.withColumns({s: F.sum(c).over(inside) for s, c in sums.items()}).join(before, same({key: "_of_key", "_block": "_of_block"}))
    return out.select(*rows.columns, *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in sums])


def with_surrogates(names: DataFrame, existing: DataFrame, columns: tuple[str, ...] = ("platform", "name")) -> DataFrame:
    """The dimension with new members added; numbers go on from the highest there is, in the order of the columns. New members
    alone are numbered, by ranges of their names, whatever these start with; a null is a name."""
    of = {c: f"_old_{c}" for c in columns}
    old = existing.select(*[F.col(c).alias(o) for c, o in of.items()])
    new = names.select(*columns).distinct().join(old, same(of), "left_anti")
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(new, [], list(columns)).select((F.col("number") + start).cast("int").alias("id"), *columns)
    return existing.select("id", *columns).unionByName(fresh)
