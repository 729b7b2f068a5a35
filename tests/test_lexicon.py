"""Terms of a table: rules of sentiment against plain Python, longest matches, a caller's model."""

import pytest
from pyspark.sql import functions as F

from weirflow.functions import lexicon, text
from weirflow.functions.lexicon import hits, sentiment_by_table, topics_by_table

TERMS = [("good", "valence", 2.0), ("bad", "valence", -2.0), ("kiss of death", "valence", -1.5), ("death", "valence", -3.0), ("very", "booster", 0.3), ("barely", "booster", -0.3), ("not", "negation", 0.0), ("but", "contrast", 0.0), ("good", "valence", 2.0), (None, "valence", 1.0)]


def score(s):
    return round(s / (s * s + 15) ** 0.5, 4) + 0.0


@pytest.mark.parametrize(
    ("sentence", "want"),
    [("good", 2.0), ("Good, good.", 4.0), ("very good", 2.3), ("very x y good", 2.27), ("barely bad", -1.7), ("not good", -1.48), ("not a x y good", 2.0), ("GOOD day", 2.733), ("GOOD DAY", 2.0), ("VERY good", 3.033), ("good but bad", -2.0), ("the kiss of death", -1.5), ("death", -3.0),
     ("good!!", 2.584), ("good!!!!!!", 3.168), ("bad??", -2.36), ("bad?????", -2.96), ("nothing!", 0.0), ("", 0.0), (None, 0.0)],
)
def test_rules(spark, sentence, want):
    terms = spark.createDataFrame(TERMS, "term string, kind string, value double")
    rows = spark.createDataFrame([(1, sentence, "x"), (1, sentence, "x"), (2, "none", "y")], "id long, t string, term string")
    got = sentiment_by_table(rows, "t", terms, ["id", "term"]).collect()
    assert sorted((r.id, r.sentiment_compound + 0.0) for r in got) == [(1, score(want)), (1, score(want)), (2, 0.0)]


@pytest.mark.parametrize("bound", [lexicon.BROADCAST_TERMS, 0])
def test_longest_terms_of_a_large_table(spark, bound, monkeypatch):
    monkeypatch.setattr(lexicon, "BROADCAST_TERMS", bound)
    names = spark.range(30_000).select(F.concat(F.lit("name"), "id").alias("term")).unionByName(spark.createDataFrame([("new york",), ("new york times",), ("times square",), ("york",), ("monday",), ("2024",), ("x",)], "term string")).withColumn("name", F.initcap("term"))
    rows = spark.createDataFrame([(1, "The New York Times, in New York; name7 Monday 2024 x name29999"), (2, "york times square new"), (3, None), (3, "")], "id long, t string")
    got = sorted((r.id, r.topics) for r in topics_by_table(rows, "t", names, ["id"]).collect())
    assert got == [(1, ["new york times", "new york", "name7", "name29999"]), (2, ["york", "times square"]), (3, []), (3, [])]
    assert hits(rows.limit(0), F.col("t"), names).count() == 0 and topics_by_table(rows, "t", names.limit(0), ["id"]).where("size(topics) > 0").count() == 0


def test_a_caller_s_model_is_loaded_in_the_worker_and_its_names_are_cleaned(spark):
    def load():
        return lambda texts: [[w for w in t.split() if w[:1].isupper()] for t in texts]

    rows = spark.createDataFrame([(1, "Paris and Monday and Paris in May"), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.topics for r in rows.select("id", text.model_topics(F.col("t"), load).alias("topics")).collect()}
    assert got == {1: ["paris", "may"], 2: [], 3: []}
