"""The thin queries over the operators of this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import codes, licenses, quality, trie


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.token_count import with_token_counts

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return with_token_counts(docs, tokenizer("piece_bpe_32k.model")).drop("text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.sharding import shard

    rows = shard(table(spark, sf_dir, "documents", "doc_id", "text"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.simhash import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4, near=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.langid import split_and_identify

    rows = split_and_identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return rows.select("doc_id", "held_out", "lang_pred", "score")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.lm import score

    return score(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.tiktoken"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.quality import assess

    rows = assess(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.mixing import SEED, mix, position

    rows = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    positions = F.transform("shards", lambda shard, copy: position(SEED, copy))
    taken = F.col("size") * F.size("shards")
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"), F.array_join(positions.cast("array<string>"), ",").alias("positions"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    rows = codes.with_group_total(coded, F.col("row.label"), "error", "label_error")
    return rows.select("row.vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.books_sha256(books)).alias("codebooks_sha256"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.pieces import encode

    rows = encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("starts", "ends").alias("spans_hash"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns_of(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return trie.prefix_trie(*trie.rebuilt(turns)).drop("position")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_nearest, op4_simhash, op5_langid, op6_lm_scores, op7_quality, op8_mixing, op9_packing, op10_licenses, op11_codes, op12_pieces, op13_trie)}
ORACLE_SQL: dict[str, str] = {"op7_quality": quality.SQL, "op10_licenses": licenses.sql(), "op11_codes": codes.SQL, "op13_trie": trie.SQL}
