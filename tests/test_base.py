"""The marts' base: increments equal the whole, joins by id without an exchange."""

from pyspark.sql import functions as F

from weirflow.operators import base, marts, state, windows
from weirflow.plans import frames
from weirflow.sources.fixtures import as_of, observations


def rows_of(df, columns):
    return sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())))


def test_increments_equal_the_whole(spark, sf_small):
    o = observations(spark, sf_small)
    days = sorted(r.day for r in o.select(F.to_date("captured_at").alias("day")).distinct().collect())
    grown = base.new_base(o.count())
    for last in (days[0], days[4], days[4], days[-1]):
        grown = base.extended(grown, o.where(F.to_date("captured_at") <= F.lit(last)))
    whole = windows.enriched(o)
    assert rows_of(grown.log(spark), whole.columns) == rows_of(whole, whole.columns)
    folded = state.fold(state.only_when_moved(whole))
    assert rows_of(grown.state(spark), folded.columns) == rows_of(folded, folded.columns)
    assert grown.version == 3 and len([t for t in spark.catalog.listTables() if t.name.startswith(grown.name)]) == 3


def test_joins_by_id_need_no_exchange(spark, sf_small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    now = as_of(spark, sf_small)
    posts, nlp = frames.staged(spark, sf_small)
    life = marts.fct_post_lifecycle(marts.dim_posts(posts, nlp), marts.post_partials(frames.stg_history(spark, sf_small)))
    near = marts.nearest_snapshots(frames.stg_history(spark, sf_small), life.where(F.col("first_seen_at") < now))
    for rows in (life, near):
        assert "Exchange" not in rows._jdf.queryExecution().sparkPlan().toString() and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert frames.marts_base(spark, sf_small) is frames.marts_base(spark, sf_small)


def test_an_empty_log_has_an_empty_base(spark, sf_small):
    empty = base.extended(base.new_base(0), observations(spark, sf_small).limit(0))
    assert empty.days is None and empty.state(spark).count() == 0
    assert base.extended(empty, observations(spark, sf_small)).days is not None
