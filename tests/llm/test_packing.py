import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weirflow.llm.packing import TextIds, pack
from weirflow.llm.queries import op9_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(rows, ids):
    """Every id in one piece, sequences gapless, lengths full."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == ids.keys()
    for doc, part in pieces.items():
        at = 0
        for r in sorted(part, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    for part in sequences.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == part[0].tier <= 1024 and at & (at - 1) == 0


def test_words_encode_like_the_library():
    rng = random.Random(5)
    alphabet = ["a", "b", " ", " ", "\n", "\t", "é", "'s", "<|endoftext|>", "The", " x", "1", "!", "\xa0", "漢"]
    alphabet += [chr(c) for c in range(33, 0x24F)]
    texts = ["", " ", "\n", " a", "a "] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    texts += ["one two\nthree x" + "ab" * 300 + " four", "plain words\nand 漢字 here\nand more", "a\nb 漢"]
    for table in (TextIds(PATH), TextIds(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))):
        assert [table.of(t) for t in texts] == [table.library(t) for t in texts]


def test_whole_table(spark, sf_small):
    model = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    whole(op9_packing(spark, sf_small).collect(), {r.doc_id: [*model.encode(r.text, add_special_tokens=False).ids, 0] for r in docs})


def test_odd_rows(spark):
    model = Tokenizer.from_file(PATH)
    texts = [None, "", "word", "the cat " * 40_000, "  two  blanks\t", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    rows = pack(docs, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    whole(rows, {i: [*model.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)})
    assert pack(docs.where("doc_id < 0"), PATH).collect() == []
    assert [r.doc_id for r in pack(spark.createDataFrame([(None, "a")], "doc_id long, text string"), PATH).collect()] == [None] * 1
