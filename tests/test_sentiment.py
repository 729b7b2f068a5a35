from pyspark.sql import functions as F

from weirflow.functions import text


def test_words_after_a_thousand_characters_are_scored(spark):
    long = "x " * 600 + "great"
    assert text.compound(long, text.LEXICON) == text.compound("great", text.LEXICON) > 0
    assert spark.createDataFrame([(long,)], "t string").select(text.sentiment(F.col("t"))).first()[0] > 0


def test_functions_equal_plain_python(spark):
    texts = ["very good", "not really good, really bad!", "good " * 3000, "no (very) slightly great sad", "", None, "  worst\n\nnever happy.", "isn't it nice? don't hate"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.sentiment(F.col("t"))).collect()
    assert [r[0] for r in rows] == [text.compound(t, text.LEXICON) for t in texts]
