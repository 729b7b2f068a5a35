import random

from pyspark.sql import functions as F

import corpus_pipeline

FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
TURKISH = "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler"


def test_stage_drops_junk_and_keeps_clean_documents_of_each_language(spark, sf_small):
    rng = random.Random(4)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(100)) for _ in range(5)]
    junk += ["@@ ## $$ %% e " * 30, "1 2 3 x 4 " * 30, FINNISH, TURKISH]
    clean = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf_small}/documents.parquet"), sf_small).select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], clean.schema)
    kept = corpus_pipeline.language(spark, clean.unionByName(planted), sf_small)
    assert {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()} == {r.lang: r["count"] for r in clean.groupBy("lang").count().collect()}
    assert kept.where(F.col("doc_id") < 0).count() == 0
