"""Pieces, spans and decoded texts against the library."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from weirflow.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def hard(n, seed=1):
    draw = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "漢", "😀", "́", "\t", "<s>", "</s>", "<0x41>", "the", "ing", " ", "ﬁ", "\r\n", "00", "\0", "Å", "①", "　"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_ids_and_spans_are_the_library_s(model):
    for text in hard(2000):
        ids, starts, ends = model.encode(text)
        want = model.library.encode(text, return_type="proto").pieces
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in want], text
        if len(ids):
            assert ends[-1] == len(text.encode()) and (starts[1:] >= starts[:-1]).all()


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps_replace_the_longest_key(rule, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze, add_dummy_prefix=True, escape_whitespaces=True)
    spec = dict(f for k, v in pieces.fields(library.serialized_model_proto()) if k == 3 for f in pieces.fields(v))
    own = pieces.Model.__new__(pieces.Model)
    own.map, own.prefix, own.squeeze = pieces.CharacterMap(spec[2]), True, squeeze
    for text in [*hard(600, 2), "ｆｕｌｌ　ｗｉｄｔｈ ½ ㍿ é", " x ", "  "]:
        normal, source = own.normalise(text)
        want, at = library.normalize(text, with_offsets=True)
        ends = [0]
        for c in text:
            ends.append(ends[-1] + len(c.encode()))
        assert normal == want and (not want or source.tolist() == [ends[i] for i in at]), text


def test_units_are_crossed_by_no_piece():
    words = ["▁the", "a", "b", "².", "1", "ab", "'s", "▁("]
    assert pieces.unit_pattern(words).findall("▁▁the².x's▁(ab)\n1") == ["▁▁the", "².", "x", "'s", "▁(", "ab", ")", "\n", "1"]
    assert pieces.unit_pattern(["a▁b"]) is None


@pytest.mark.parametrize("unit", ["a" * 700, "ab" * 400, "the" * 300, "".join(random.Random(4).choice("aeinrst漢") for _ in range(900))])
def test_windows_change_nothing(model, unit):
    whole = model.merged(unit)
    assert all(list(model.pieces(unit, window)) == whole for window in (16, 50, 333))
    assert model.merged_short(unit[:40]) == model.merged(unit[:40])


def test_whole_table_and_odd_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").withColumns({"ids": F.lit("x"), "row": F.lit(1), "decoded": F.lit(2)})
    odd = spark.createDataFrame([(-1, None, "x", 1, 2), (-2, "", "x", 1, 2), (-3, "a", "x", 1, 2), (-3, "a", "x", 1, 2), (None, " ", "x", 1, 2), (-4, "x7Kq " * 40_000, "x", 1, 2), (-5, "x7Kq" * 40_000, "x", 1, 2)], docs.schema)
    rows = docs.unionByName(odd)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((repr(r.doc_id), i := library.encode(r.text or ""), library.decode(i) if i else "") for r in rows.collect())
    got = pieces.encode(rows, PATH).collect()
    assert sorted((repr(r.row.doc_id), r.ids, r.decoded) for r in got) == want
    assert {r.row.ids for r in got} == {"x"} and all(len(r.ids) == len(r.starts) == len(r.ends) for r in got)
    assert pieces.encode(rows.limit(0), PATH).count() == 0
