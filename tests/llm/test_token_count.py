import random

import public_tokenizers
import pytest
import sentencepiece

from weirflow.llm.token_count import UnitCounts, with_token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library_on_hard_strings(library):
    rng = random.Random(3)
    alphabet = "ab  \n\t▁é漢😀<s>thein\x00e"
    texts = ["", " ", "   a", "a    ", "a" * 3000, "<s>x</s>", "▁x"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    counts = UnitCounts(MODEL)
    assert [counts.of(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_whole_table_and_odd_rows(spark, sf_small, library):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (1, None), (2, ""), (2, ""), (3, "the " * 60000)], "doc_id long, text string")
    rows = with_token_counts(docs.union(odd), MODEL).collect()
    assert len(rows) == docs.count() + 5
    for r in rows:
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(library.encode(text)), len(library.encode(text)) > 4096)


def test_unbroken_texts_are_counted_in_windows(library):
    draw = random.Random(5)
    counts = UnitCounts(MODEL)
    for unit in ("a" * 150_000, "x7Kq" * 40_000, "".join(draw.choice("aeinrst漢") for _ in range(140_000))):
        assert counts.of(unit) == len(library.encode(unit))


def test_columns_of_the_result_s_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, n_tokens string")
    assert with_token_counts(rows, MODEL).select("n_tokens").first()[0] == 2


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens long")
    assert with_token_counts(none, MODEL).collect() == []
